import itertools
import re
import time
from html import unescape
from html.parser import HTMLParser

import pytest

from tagwright.llm import html


def text(page, deleted=()):
    return "\n".join(html.blocks(html.parse(page), set(deleted)))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav>menu</nav><article><h1>A&eacute;</h1><p><b>one\n two<br><p>three&nbsp;four</p></article><footer>f</footer>", "Aé\none two\nthree four"),
        ("<article><p>a</p><script>var t='</p>';</script><style>p{}</style><form>x</form><p>b &lt;i&gt;</p></article> after", "a\nb <i>"),
        ("<body><div class='cookie-notice'>no</div><div class=ad>no</div><div id=comments><p>no</p></div><p>yes</p></body>", "yes"),
        ("<body><div class='site-header'>no</div><div id='header'>no</div><div class='left side-bar'>no</div><section id='reader-comments'>no</section><div class='adored'>yes</div></body>", "yes"),
        ("<main><aside>no</aside><section><p>1<p>2</section><!-- no --><ul><li>x<li>y</ul></main>", "1\n2\nx\ny"),
        ("<p>1 < 2 <b>bold", "1 < 2 bold"),
        ("<p title='a>b'>x<p title=\"unclosed>y", "x\ny"),
        ("<title>t</title><h1>h</h1>", "h"),
        ("<header>site</header><article><header><h1>h</h1></header><p>b</p></article>", "h\nb"),
        ("<![CDATA[raw]]> x", "raw x"),
        ("<article>" + "<div>" * 400 + "deep" + "</div>" * 400 + "</article>", "deep"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def test_templates_are_removed_by_host(spark):
    page = "<html><body><div><p>Welcome to our site</p></div><div>Copyright Example</div><p>Body {0} of the page, longer than what is around it.</p></body></html>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(8)] + [(100, "http://b.example/", page.format(100)), (101, None, None), (102, "http://a.example/", "")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Body 3 of the page, longer than what is around it." and got[3].n_chars == len(got[3].text) and got[3].url == "http://a.example/3"
    assert got[100].text.startswith("Welcome to our site\nCopyright") and got[101].text == "" and got[102].text == ""


def test_articles_that_recur_stay(spark):
    page = "<body><div><a href=x>top</a></div><article><h1>T</h1><p>The same text on each page.</p><div class=box>Read more</div></article></body>"
    rows = [(k, "http://a.example/", page) for k in range(9)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 9 and {r.text for r in got} == {"T\nThe same text on each page."}


def test_copies_of_a_page_lose_nothing(spark):
    listed = "<article><h1>T</h1><p>Some words of the first of all paragraphs here.</p><ul><li>one</ul><table><tr><td>cell</table><section><p>part</section><div><p>in a div</div></article>"
    plain = "<body><h1>Head</h1><p>one two</p><p>three four</p><p>five six</p></body>"
    rows = [(k, "http://a.example/", listed) for k in range(9)] + [(k, "http://b.example/", plain) for k in range(10, 19)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got if r.page_id < 10} == {"T\nSome words of the first of all paragraphs here.\none\ncell\npart\nin a div"}
    assert {r.text for r in got if r.page_id >= 10} == {"Head\none two\nthree four\nfive six"}


def test_five_main_texts_are_enough(spark):
    rows = [(10 * h + k, f"http://{h}.example/{k}", f"<body><div>Box of few pages</div><p>Body {h} {k} of the page, longer than what is around it.</p></body>") for h in range(60) for k in range(5 if h % 2 else 4)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.text.startswith("Body") == bool(int(r.url.split("/")[2].split(".")[0]) % 2) for r in got)


def test_the_bar_is_the_same_on_large_hosts(spark):
    page = "<body>{1}<p>Body {0} of the page, longer than what is around it.</p></body>"
    rows = [(k, "http://a.example/", page.format(k, "<div>Box of six pages</div>" if k < 6 else "")) for k in range(700)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 700 and all(r.text == f"Body {r.page_id} of the page, longer than what is around it." for r in got)


def test_deep_nesting(spark):
    want = {"font": "first\ndeep", "div": "first\ndeep", "main": "deep", "span class=ad": "first", "ul": "first\ndeep"}
    rows = [(k, "http://a.example/", "<p>first</p>" + f"<{tag}>" * 100_000 + "deep" + "</i></b>" * 1000) for k, tag in enumerate(want)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == list(want.values())


OPEN_ENDED = ("<a " * 350_000, "<a '" * 250_000 + ">", "<a x=\"" * 150_001 + "> <a ' >" * 20_000, "<!" * 500_000, "<b><!-- " * 100_000, "<script>" * 120_000 + ">", "</a" * 300_000 + ">x")


def test_tags_that_dont_close_are_read_once(spark):
    start = time.monotonic()
    rows = [(k, "http://a.example/", "<p>first</p>" + source) for k, source in enumerate(OPEN_ENDED)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.text.startswith("first") for r in got) and time.monotonic() - start < 120


def test_many_templates_are_joined_in_parts(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", f"<body><div>Box of host {k % 2}</div><p>Body {k} of the page, longer than what is around it.</p></body>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, two = (sorted(map(tuple, html.extract(pages, broadcast_rows=n).collect())) for n in (1_000_000, 0))
    assert one == two and all(r[2].startswith("Body") for r in one)


class Plain(HTMLParser):
    """A tree of [tag, side, main, children, start, end] made by the library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.lines = [0, *itertools.accumulate(len(x) for x in page.splitlines(keepends=True))]
        self.page, self.root = page, ["html", False, False, [], 0, len(page)]
        self.open, self.seen = [self.root], set()
        self.feed(page)
        self.close()
        for e in self.open:
            e[5] = len(page)

    def at(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def shut(self, k, at):
        for e in self.open[k:]:
            e[5] = at
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        at, end = self.at(), self.at() + len(self.get_starttag_text())
        if tag in ("html", "body") and tag in self.seen:
            return
        self.seen.add(tag)
        blocks = [k for k, e in enumerate(self.open) if e[0] in html.BLOCK and k]
        if blocks and tag in html.CLOSES.get(self.open[blocks[-1]][0], ()):
            self.shut(blocks[-1], at)
        if tag == "body":
            self.shut(1, at)
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        side = tag in html.LEFT_OUT or bool(names and tag not in ("article", "main", "body") and html.SIDE.search(names))
        e = [tag, side, tag in ("article", "main"), [], at, end]
        self.open[-1][3].append(e)
        if tag not in html.VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        mine = [k for k, e in enumerate(self.open) if e[0] == tag and k]
        main = [k for k, e in enumerate(self.open) if e[2]]
        if mine and (tag in ("body", "html") or not main or main[-1] <= mine[-1]):
            self.shut(mine[-1], self.page.index(">", self.at()) + 1)

    def handle_data(self, data):
        self.open[-1][3].append(data)

    def handle_entityref(self, name):
        at = self.at()
        self.open[-1][3].append(f"&{name}" + (";" if self.page[at + 1 + len(name) : at + 2 + len(name)] == ";" else ""))

    def handle_charref(self, name):
        self.handle_entityref("#" + name)


def brute_texts(rows):
    def words(e):
        return sum(len(c.split()) if isinstance(c, str) else words(c) for c in e[3])

    def has_main(e):
        return any(not isinstance(c, str) and (c[2] or has_main(c)) for c in e[3])

    def walk(e, inside, found):
        for c in e[3]:
            if isinstance(c, str):
                continue
            if c[0] not in ("html", "body", "head", "br") and not c[2] and not has_main(c) and not (inside and c[0] in html.TEXT) and c[3]:
                found.append((c, inside and c[0] == "div" and all(isinstance(x, str) for x in c[3])))
            walk(c, inside or c[2], found)
        return found

    def told(root, gone):
        lines, whole = [[]], not has_main(root)

        def read(e, inside):
            for c in e[3]:
                if isinstance(c, str):
                    if inside:
                        lines[-1].append(c)
                    continue
                block = c[0] in html.BLOCK
                if c[0] == "br":
                    lines[-1].append(" ")
                    continue
                if block:
                    lines.append([])
                if not (c[1] or id(c) in gone or (c[0] == "header" and not (inside and not whole))):
                    read(c, inside or c[2])
                if block:
                    lines.append([])

        read(root, whole)
        return "\n".join(x for x in (" ".join(unescape("".join(line)).split()) for line in lines) if x)

    pages, mains, boxes = [], {}, {}
    for _, url, page in rows:
        root = Plain(page).root
        host = re.split("[/?#]", (url or "").split("://", 1)[-1], maxsplit=1)[0].lower() if "://" in (url or "") else ""
        most = words(root) / 2
        found = [(c, " ".join(page[c[4] : c[5]].split()), box) for c, box in walk(root, False, []) if c[1] or words(c) <= most]
        pages.append((host, root, found))
        for key in {(host, source) for _, source, _ in found}:
            mains.setdefault(key, set()).add(told(root, set()))
        for key in {(host, source) for _, source, box in found if box}:
            boxes[key] = boxes.get(key, 0) + 1
    return [told(root, {id(c) for c, source, _ in found if len(mains[host, source]) >= html.PAGES or boxes.get((host, source), 0) >= html.PAGES}) for host, root, found in pages]


def test_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(1000 + k, f"https://x.example/{k}", f"<body><ul><li>menu<li>b</ul><div class=x>hello</div><article><h1>T{k}</h1><p>Some text {k} &amp; more</p><div>box</div><section><p>same part</p></section></article></body>") for k in range(8)]
    rows += [(2000 + k, f"https://y.example/{k}", f"<table><tr><td>a<td>b<tr><td>c</table><p>Body {k}<p>one more paragraph with {k} words<br>and a line") for k in range(7)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for (i, _, _), want in zip(rows, brute_texts(rows), strict=True):
        assert got[i].text == want and got[i].n_chars == len(want), i


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
