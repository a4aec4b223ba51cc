"""Main text of web pages, with each site's template removed.

A page is read as a tree of elements. Every element that holds no running text of the main
part (outside article and main: all but the body; inside them: containers such as div, aside
or ul) is hashed with all it contains. Hashes are counted per host, once for each distinct main text,
and an element that recurs with PAGES of them is template, however large the host: it is deleted, unless
it is most of its page's text. Copies of a page tell nothing about what is template, but for a box, a div
in an article with no element in it: it is counted once a row. What pages have by their kind alone (scripts, navigation, forms, adverts, comments by
readers) is left out as well. The rest of the article, or of the body where there is none,
is cut into blocks: white space inside one becomes one space, and blocks are joined by a newline.

Cases: null and empty pages give an empty text, and so do pages without text; a null url's host
is ""; broken markup is read as far as it goes: unclosed elements end with their parents, a
bare "<" is text; repeated pages have a row each; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.storage import materialise

#: An element is template if this many pages of its host have it, counted by their main texts.
PAGES = 5

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("head nav footer aside form script style textarea title noscript iframe xmp noembed noframes template button select input object embed svg canvas audio video menu dialog".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption a b i em strong span u s small code sub sup q cite mark time abbr font label".split())
MAIN = frozenset(("article", "main"))
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"])}
#: Words in class, id or role that name what isn't main text.
SIDE = re.compile(r"(?:^|[\s_-])(?:ads?\d*|advert\w*|alerts?|banner|breadcrumbs?|comment\w*|consent|cookies?|disqus|footer|gdpr|(?:site|page|main|global|top)[_-]?header|masthead|menu|navbar|navigation|nav|newsletter|notices?|popup|promo\w*|related|share|sharing|side-?bar|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])|^header$", re.I)

OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|(!\[CDATA\[)|[!?])")
MARK = re.compile(r"""[>"']""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Tags:
    """Where the page's tags end. Each place is looked at a bounded number of times, whatever is left open."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.known: dict[int, int] = {}  # the end of a tag that goes on, outside quotes, at this place; -1: it has none

    def end(self, at: int) -> int:
        """The place after the > that ends a tag which goes on at ``at``, or -1: the first > outside quotes, or the first at all where quotes don't close."""
        if at > self.last:
            return -1
        steps, place, found = [], at, None
        while found is None:
            if place in self.known:
                found = self.known[place]
                break
            steps.append(place)
            m = MARK.search(self.html, place)
            if m is None:
                found = -1
            elif m[0] == ">":
                found = m.end()
            else:
                close = self.html.find(m[0], m.end())
                if close < 0:
                    found = -1
                place = close + 1
        for x in steps:
            self.known[x] = found
        return found if found >= 0 else self.html.index(">", at) + 1


class Element:
    __slots__ = ("tag", "start", "end", "children", "side", "main", "has_main")

    def __init__(self, tag: str, start: int, side: bool, main: bool):
        self.tag, self.start, self.end, self.children, self.side, self.main, self.has_main = tag, start, start, [], side, main, False


def parse(html: str) -> Element:
    """The page's elements; a child is an element or a piece of text, with references still in it."""
    root = Element("html", 0, False, False)
    stack, at, n = [root], 0, len(html)  # at: up to where the page is read
    opened: dict[str, list[int]] = {}  # places in the stack, by tag; of blocks; of article and main
    block_at: list[int] = []
    main_at: list[int] = []

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].children.append(html[a:b])

    def close(k: int, end: int) -> None:
        while len(stack) > k:
            element = stack.pop()
            element.end = end
            opened[element.tag].pop()
            if element.tag in BLOCK:
                block_at.pop()
            if element.tag in MAIN:
                main_at.pop()

    tags, ends = Tags(html), {}
    start = 0  # where to look for the next tag
    while (m := OPEN.search(html, start)) is not None:
        if not m[2]:  # a comment, raw text or a declaration, to its end or the page's
            mark = "-->" if m[3] else "]]>" if m[4] else ">"
            end = html.find(mark, m.end())
            text(at, m.start())
            at = start = n if end < 0 else end + len(mark)
            if m[4]:
                text(m.end(), n if end < 0 else end)
            continue
        end = tags.end(m.end())
        if end < 0:  # no tag: text
            start = m.end()
            continue
        text(at, m.start())
        tag, attributes = m[2].lower(), html[m.end() : end - 1]
        at = start = end
        if m[1]:
            # a stray end tag doesn't end the article
            if opened.get(tag) and (tag in ("body", "html") or not main_at or main_at[-1] <= opened[tag][-1]):
                close(opened[tag][-1], at)
            continue
        if tag in ("html", "body") and opened.get(tag):
            continue
        if block_at and tag in CLOSES.get(stack[block_at[-1]].tag, ()):  # what a start tag ends by itself
            close(block_at[-1], m.start())
        if tag == "body":  # a head without an end
            close(1, m.start())
        names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)) if "=" in attributes else ""
        element = Element(tag, m.start(), tag in LEFT_OUT or bool(names and tag not in MAIN and tag != "body" and SIDE.search(names)), tag in MAIN or names == "main")
        stack[-1].children.append(element)
        if element.main:
            for e in reversed(stack):
                if e.has_main:
                    break
                e.has_main = True
        if tag in VOID or attributes.endswith("/"):
            element.end = at
        elif tag in RAW:
            if tag not in ends:
                ends[tag] = re.compile(rf"</{tag}(?![a-zA-Z0-9])[^>]*+>", re.I)
            end = ends[tag].search(html, at) if at <= tags.last else None
            element.end = at = start = end.end() if end else n
        else:
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                block_at.append(len(stack))
            if tag in MAIN:
                main_at.append(len(stack))
            stack.append(element)
    text(at, n)
    close(1, n)
    root.end = n
    return root


def _digest(source: str) -> int:
    return int.from_bytes(hashlib.blake2b(source.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def fingerprint(html: str, element: Element, inner: dict[int, int]) -> int:
    """A hash of the element's source, with the hashes of the elements in it, by id(), for theirs."""
    parts, at = [], element.start
    for c in element.children:
        if not isinstance(c, str):
            parts += " ".join(html[at : c.start].split()), f"\x00{inner[id(c)]}\x00"
            at = c.end
    return _digest("".join([*parts, " ".join(html[at : element.end].split())]))


def candidates(html: str, root: Element):
    """(element, hash, whether it is a box) of each element that may be template."""
    order = [(root, False)]
    for element, inside in order:  # grows while it is read: parents before their children
        order += [(c, inside or c.main) for c in element.children if not isinstance(c, str)]
    words: dict[int, int] = {}
    hashes: dict[int, int] = {}
    for element, _ in reversed(order):
        words[id(element)] = sum(len(c.split()) if isinstance(c, str) else words[id(c)] for c in element.children)
        hashes[id(element)] = fingerprint(html, element, hashes)
    most = 0.5 * words[id(root)]
    for element, inside in order:
        for c in element.children:
            if isinstance(c, str) or c.tag in ("html", "body", "head", "br") or c.main or c.has_main or (inside and c.tag in TEXT) or not c.children:
                continue
            if c.side or words[id(c)] <= most:
                yield c, hashes[id(c)], inside and c.tag == "div" and all(isinstance(x, str) for x in c.children)


def blocks(root: Element, deleted: frozenset[int] | set[int]) -> list[str]:
    """The main text's blocks. deleted: id() of the elements to leave out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            found = " ".join(unescape("".join(line)).split())
            line.clear()
            if found:
                out.append(found)

    todo = [(iter(root.children), not root.has_main, False)]  # what is left of each open element, and whether it is a block
    while todo:
        children, inside, block = todo[-1]
        for c in children:
            if isinstance(c, str):
                if inside:
                    line.append(c)
            elif c.side or id(c) in deleted:
                if c.tag in BLOCK:
                    flush()
            elif c.tag == "header" and not (inside and root.has_main):
                flush()  # the page's header, not the article's
            elif c.tag == "br":
                line.append(" ")
            else:
                if c.tag in BLOCK:
                    flush()
                todo.append((iter(c.children), inside or c.main or not root.has_main, c.tag in BLOCK))
                break
        else:
            todo.pop()
            if block:
                flush()
    flush()
    return out


def host(url: str = "url") -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty without a ://."""
    after = F.expr(f"substring(`{url}`, length(substring_index(`{url}`, '://', 1)) + 4)")
    found = F.regexp_extract(after, r"^[^/?#]*", 0)
    lower = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(F.col(url), F.lit("://")), lower).otherwise(F.lit(""))


def _hashes(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            main, found, boxes = [], [], []
            for html in part.column("html").to_pylist():
                root = parse(html or "")
                some = [(h, box) for _, h, box in candidates(html or "", root)]
                main.append(_digest("\n".join(blocks(root, frozenset()))))
                found.append(sorted({h for h, _ in some}))
                boxes.append(sorted({h for h, box in some if box}))
            hashes = (pa.array(x, pa.list_(pa.int64())) for x in (found, boxes))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array(main, pa.int64()), *hashes], ["page_id", "host", "main", "hashes", "boxes"])


def _extract(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = []
            for html, known in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True):
                root = parse(html or "")
                known = set(known or ())
                gone = {id(e) for e, h, _ in candidates(html or "", root) if h in known} if known else set()
                texts.append("\n".join(blocks(root, gone)))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


#: Rows of 16 bytes that a broadcast may have; with more templates the join is shuffled, in SALTS parts of each.
BROADCAST_ROWS = 1_000_000
SALTS = 32


def extract(pages: DataFrame, least: int = PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    seen = rows.select("page_id", "host", "html").mapInArrow(_hashes, "page_id long, host string, main long, hashes array<long>, boxes array<long>")
    seen = materialise(seen.withColumn("host", F.xxhash64("host")), "subtrees")
    each = seen.select("page_id", "host", "main", "boxes", F.explode("hashes").alias("h"))
    # main texts set one of 64 bits: so many bits are so many texts at least, and only where they are too few are texts compared
    bit, box = F.expr("shiftleft(1L, cast(pmod(main, 64) as int))"), F.array_contains("boxes", F.col("h")).cast("int")
    counts = each.groupBy("host", "h").agg(F.count("*").alias("n"), F.bit_count(F.bit_or(bit)).alias("bits"), F.sum(box).alias("boxes")).where(F.col("n") >= least)
    counts = materialise(counts.select("host", "h", ((F.col("bits") >= least) | (F.col("boxes") >= least)).alias("sure")), "counts")
    unsure = counts.where("not sure").select("host", "h")
    mains = _met(each.select("host", "h", "main", "page_id"), unsure, broadcast_rows).select("host", "h", "main").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    template = materialise(counts.where("sure").select("host", "h").unionByName(mains.where(F.col("n") >= least).select("host", "h")), "template")
    own = _met(each.select("page_id", "host", "h"), template, broadcast_rows)
    deleted = materialise(own.groupBy("page_id").agg(F.collect_set("h").alias("template")), "deleted")  # a page's own elements at most
    return rows.join(deleted, "page_id", "left").select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def _met(each: DataFrame, some: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of ``each(host, h, page_id)`` whose (host, h) is in ``some``. A hot host's pages are dealt over parts."""
    if some.count() <= broadcast_rows:
        return each.join(F.broadcast(some), ["host", "h"], "left_semi")
    parts = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(parts, ["host", "h", "salt"], "left_semi").drop("salt")
