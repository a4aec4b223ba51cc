import random
import re

import numpy as np

from tagwright.llm import urls

URLS = [
    (1, "http://A.Example.ORG/en/2?x=/es/", "org/", "allow"),
    (2, "https://www.example.org/es/1#top", "example.org/es/", "block"),
    (3, "https://notexample.org/es/1", "org/", "allow"),
    (4, "http://example.org/en/12", "example.org/en/1", "block"),
    (5, "http://x.com/fr/a", "com/fr/", "allow"),
    (6, "http://x.com/de/a", "com/de/", "block"),
    (7, "http://plain.org", None, "allow"),
    (8, "no scheme", None, "allow"),
    (9, None, None, "allow"),
    (10, "http://x.net/a://b/c", None, "allow"),
    (11, "", None, "allow"),
    (12, "http://h.com:80/de/", None, "allow"),
]


def test_rules(spark):
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, None, "h") for i, u, *_ in URLS], "page_id long, url string, html string, host string")).collect()}
    for i, _, rule, verdict in URLS:
        assert (got[i].rule, got[i].verdict) == (rule, verdict), i
    assert (got[1].host, got[1].path) == ("a.example.org", "/en/2") and (got[7].host, got[7].path) == ("plain.org", "")
    assert (got[8].host, got[8].path) == ("", "") and (got[10].host, got[10].path) == ("x.net", "/a://b/c")


def test_distrust_runs_back_along_links(spark):
    link = '<a class="x" href="{0}">y</a>'.format
    pages = [
        (1, "http://bad.com/de/1", ""),
        (2, "http://fan.net/1", link("http://bad.com/de/1") + link("HTTPS://bad.com/x") + link("/own")),
        (3, "http://good.org/1", link("//friend.net/") + link("http://good.org/2")),
        (4, "http://friend.net/1", link("http://nowhere.net/")),
        (5, "http://far.net/1", None),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k].verdict for k in (1, 2, 3, 4, 5)] == ["block", "block", "allow", "allow", "allow"]
    assert got[4].trust > 0 and got[2].distrust > 0 and got[5].trust == got[5].distrust == 0


def test_verdicts_dont_depend_on_the_number_of_linkers(spark):
    for n in (1, 3, 1000):
        pages = [(0, "http://bad.com/de/1", ""), *((k, f"http://fan{k}.net/1", '<a href="http://bad.com/de/1">y</a>') for k in range(1, n + 1))]
        pages += [(2000, "http://apart.net/1", '<a href="http://other.net/">y</a>'), (2001, "http://other.net/1", "")]
        got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert {k for k, v in got.items() if v == "block"} == set(range(n + 1)), n


def test_ranks_equal_the_matrix_form(spark):
    rng = np.random.default_rng(0)
    n = 12
    w = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.4)
    np.fill_diagonal(w, 0)
    s, d = rng.random(n) * (rng.random(n) < 0.3), rng.random(n) * (rng.random(n) < 0.3)
    links = [(f"h{a}", f"h{b}", int(w[a, b])) for a in range(n) for b in range(n) if w[a, b]]
    seeds = [(f"h{k}", float(s[k]), float(d[k])) for k in range(n)]
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(links, "source string, target string, n long")).collect()}
    out = np.divide(w, w.sum(1, keepdims=True), where=w.sum(1, keepdims=True) > 0, out=np.zeros((n, n)))
    back = np.divide(w.T, w.T.sum(1, keepdims=True), where=w.T.sum(1, keepdims=True) > 0, out=np.zeros((n, n)))
    for m, seed, k in ((out, s, 0), (back, d, 1)):
        want = np.linalg.solve(np.eye(n) - 0.85 * m.T, 0.15 * seed)
        assert np.allclose([got[f"h{i}"][k] for i in range(n)], want, atol=5e-3)


def test_long_chains_settle(spark):
    """Trust comes to the end of a chain, and to that of a ring, whatever the number of rounds this takes."""
    n = 45
    links = [(f"h{k:02d}", f"h{k + 1:02d}", 1) for k in range(n)] + [("r0", "r1", 1), ("r1", "r0", 1)]
    seeds = [("h00", 1.0, 0.0), ("r0", 1.0, 0.0)]
    got = {r.host: r for r in urls.propagate(spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(links, "source string, target string, n long")).collect()}
    for k in range(n + 1):
        assert abs(got[f"h{k:02d}"].trust / (0.15 * 0.85**k) - 1) < 0.01 or 0.15 * 0.85**k < 1e-3, k
    assert abs(got["r0"].trust / (0.15 / (1 - 0.85**2)) - 1) < 0.02


def brute_verdicts(pages, damping=0.85):
    """Verdicts by hand: rules, seeds, links and ranks as matrices."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return host.translate(low), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    told, seen, links = [], {}, {}
    for _, url, html in pages:
        host, path = split(url)
        fit = [(len(h + p), v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        told.append((host, max(fit)[1] if fit else None))
        if host:
            seen.setdefault(host, []).append(told[-1][1])
            for to in re.findall(r'href="([^"]*)"', html or ""):
                other = split(to)[0]
                if other and other != host:
                    links[host, other] = links.get((host, other), 0) + 1
    names = sorted({*seen, *(h for pair in links for h in pair)})
    at = {h: k for k, h in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    out = np.divide(w, w.sum(1, keepdims=True), where=w.sum(1, keepdims=True) > 0, out=np.zeros_like(w))
    seed = {v: np.array([seen.get(h, [None]).count(v) / len(seen.get(h, [None])) for h in names]) for v in ("allow", "block")}
    solve = lambda m, s: np.linalg.solve(np.eye(len(names)) - damping * m, (1 - damping) * s)
    one = np.ones(len(names))
    trust, blame = solve(out.T, seed["allow"]) / solve(out.T, one), solve(out, seed["block"]) / solve(out, one)
    bad = (blame >= urls.LEAST) & (blame > urls.RATIO * trust)
    return [v or ("block" if h and bad[at[h]] else "allow") for h, v in told]


def test_verdicts_equal_the_matrix_form(spark):
    rng = random.Random(6)
    hosts = [f"h{k}.net" for k in range(14)] + ["bad.com", "a.example.org", "fr.com"]
    paths = {"bad.com": "/de/1", "a.example.org": "/es/2", "fr.com": "/fr/3"}
    url = lambda h: f"http://{h}{paths.get(h, '/x')}"
    pages = []
    for k in range(40):
        h = hosts[k % len(hosts)]
        pages.append((k, url(h), "".join(f'<a href="{url(rng.choice(hosts))}">y</a>' for _ in range(rng.randrange(0, 4)))))
    pages += [(100, None, ""), (101, "", None), (102, "http://bad.com/", None), pages[3]]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).select("page_id", "verdict").collect()
    want = sorted(zip([p[0] for p in pages], brute_verdicts(pages), strict=True))
    assert sorted(map(tuple, got)) == want and {v for _, v in want} == {"allow", "block"}


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
