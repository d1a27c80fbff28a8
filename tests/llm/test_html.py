"""The style tree against brute force, and odd pages."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from terraline.llm import html_text

KINDS = "page_id long, url string, html string"


def site(rng, n):
    """Pages of several hosts: a menu that a host repeats, a box with one of three texts, paragraphs of their own."""
    rows = []
    for i in range(n):
        host = rng.choice(["a.example", "b.example", "c.example"])
        own = " ".join(rng.choice("abcdefgh") * 4 for _ in range(12))
        body = f"<div class=top>menu of {host}</div><div class=box><i>{rng.choice('xyz')}</i></div>"
        body += f"<article><h1>{own[:20]}</h1><p>{own}</p></article>" if rng.random() < 0.5 else f"<div><p>{own}</p><p>{own[::-1]}</p></div>"
        rows.append((i, f"https://{host}/{i}", f"<body>{body}</body>"))
    return rows


def entropies(rows):
    """(host, node): pages, pages of the pool, presentation, content, importance, shrunk, by counting looks in plain Python."""
    looks, pools, names = defaultdict(set), defaultdict(list), {}
    for _, url, source in rows:
        page = html_text.Page(source or "")
        for path, (label, way, text, inside, doubtful) in page.nodes.items():
            looks[url.split("/")[2], path].add((way, text, page.main_block()))
            names[url.split("/")[2], path] = label or path, doubtful
    for key, seen in looks.items():
        pools[names[key][0]] += seen
    k, out = html_text.PRIOR, {}
    for key, seen in looks.items():
        n, pool, means = len(seen), pools[names[key][0]], []
        for kind in (0, 1):
            here, everywhere = Counter(x[kind] for x in seen), Counter(x[kind] for x in pool)
            of_host = lambda x: math.log(here[x]) / math.log(n) * n / (n + k) if n > 1 else 0.0
            of_all = lambda x: math.log(everywhere[x]) / math.log(len(pool)) if everywhere[x] > 1 else 0.0
            means.append(sum(max(of_host(x[kind]), of_all(x[kind])) for x in seen) / n)
        importance = 1 - means[0] * means[1]
        shrunk = (len(pool) * importance + k * (not names[key][1])) / (len(pool) + k)
        out[key] = n, len(pool), 1 - means[0], 1 - means[1], importance, shrunk
    return out


def test_entropies_and_importance(spark):
    rows = site(random.Random(1), 150)
    rows += [(1000 + i, r[1], r[2]) for i, r in enumerate(rows[:40])]  # copies
    want = entropies(rows)
    got = html_text.style_tree(spark.createDataFrame(rows, KINDS)).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_pages, r.n_all, r.presentation, r.content, r.importance, r.shrunk) == pytest.approx(want[r.host, r.node & (2**64 - 1)])


@pytest.mark.parametrize("most", [100_000, 0])
def test_low_branches_go(spark, monkeypatch, most):
    """By broadcast and by the shuffle that large sites take, with small groups."""
    monkeypatch.setattr(html_text, "MAX_BROADCAST_NODES", most)
    monkeypatch.setattr(html_text, "PAGES_AT_ONCE", 7)
    rows = site(random.Random(2), 200)
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, KINDS)).collect()}
    assert len(got) == 200
    for i, _, source in rows:
        page = html_text.Page(source)
        texts = [t for t, *_ in page.blocks if not t.startswith("menu of") and t not in "xyz"]
        assert got[i] == "\n\n".join(texts)


def test_odd_tables(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "http://h/", ""), (3, "http://h/", "<p>" + "long text " * 50_000)]
    df = spark.createDataFrame(rows, KINDS).withColumns({"text": F.lit("old"), "host": F.lit(5), "node": F.lit("n"), "_host": F.lit(7)})
    got = html_text.main_text(df).orderBy("page_id").collect()
    assert [r.text[:9] for r in got] == ["", "a", "a", "", "long text"] and {(r.host, r.node, r._host) for r in got} == {(5, "n", 7)}
    assert len(got[-1].text) == 499_999 and html_text.main_text(df.limit(0)).count() == 0


def test_deep_and_unclosed_pages():
    tracemalloc.start()
    deep = html_text.Page("<div>" * 200_000 + "end")
    assert deep.main_text() == "end" and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert html_text.Page("<b>x " * 50_000 + "</i>" * 50_000).main_text().startswith("x x")


def test_importance_never_takes_an_article():
    page = html_text.Page("<div><article><p>one</p><p class=x>two words here</p></article><p>beside</p></div>")
    paths = frozenset(page.nodes)
    assert html_text.Page("<div><article><p>one</p><p class=x>two words here</p></article><p>beside</p></div>", low=paths).main_text() == "one\n\ntwo words here"


class Paragraphs(HTMLParser):
    """The text of h1 and p elements, by Python's own parser; the pages of ``mixed_sites`` have no other main text."""

    def __init__(self, source):
        super().__init__()
        self.found, self.open = [], False
        self.feed(source)

    def handle_starttag(self, tag, attributes):
        if tag in ("h1", "p"):
            self.found.append("")
            self.open = True

    def handle_endtag(self, tag):
        self.open = self.open and tag not in ("h1", "p")

    def handle_data(self, data):
        if self.open:
            self.found[-1] += data


def mixed_sites(rng, n, boxed="<div class='{}'><span>{}</span></div>"):
    """Pages of five hosts, most without an article: a strip that the host repeats, a box of one of twenty rotating texts
    that all hosts share, before the paragraphs or among them. No class says what they are."""
    rows = []
    for i in range(n):
        host = rng.choice("abcde") + ".example"
        words = [rng.choice("abcdefghij") * rng.randint(2, 9) for _ in range(40)]
        ps = [f"<p>{' '.join(words[:9])} &amp; more</p>", f"<p>{' '.join(words[9:])}</p>"]
        box = boxed.format("c7", f"rotating text {rng.randrange(20)}")
        ps.insert(rng.randint(0, 2), box)
        inner = f"<h1>{words[0]} {i}</h1>" + "".join(ps)
        kind = "article" if host == "a.example" else "div"
        rows.append((i, f"https://{host}/{i}", f"<body><div class=k>all about {host}</div><{kind}>{inner}</{kind}></body>"))
    return rows


def test_entropies_decide_with_and_without_articles(spark, monkeypatch):
    """Adverts inside and outside of articles go by their entropies alone: without the prior the text is the same, and
    without the entropies every page keeps them."""
    rows = mixed_sites(random.Random(3), 400)
    df = spark.createDataFrame(rows, KINDS)
    want = {i: "\n\n".join(Paragraphs(source).found) for i, _, source in rows}
    texts = lambda: {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert texts() == want
    monkeypatch.setattr(html_text, "PRIOR", 0)
    assert texts() == want
    monkeypatch.setattr(html_text, "PRIOR", 1e15)
    got = texts()
    assert all("rotating text" in got[i] and "all about" in got[i] for i in got)


def test_another_hosts_repeats_touch_no_text_of_ones_own(spark):
    """A host with a third of all pages repeats a text in the very place where others have their own."""
    rows = [(i, "https://hot.example/", f"<body><div>always the same</div><p>{i} own words</p></body>") for i in range(100)]
    rows += [(100 + i, f"https://h{i % 40}.example/", f"<body><div>of {i} alone</div></body>") for i in range(200)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, KINDS)).collect()}
    assert all(got[i] == f"{i} own words" for i in range(100)) and all(got[100 + i] == f"of {i} alone" for i in range(200))


def test_names_decide_on_a_handful_of_pages(spark):
    rows = [(i, "https://h.example/", f"<body><div class=ad>advert {i}</div><div class=x>text {i}</div></body>") for i in range(3)]
    assert {r.text for r in html_text.main_text(spark.createDataFrame(rows, KINDS)).collect()} == {"text 0", "text 1", "text 2"}


def test_headings_of_near_copies_stay(spark):
    rows = [(i, f"https://h{i % 3}.example/", f"<article><h1>One title</h1><p>{i} a near copy</p></article>") for i in range(90)]
    assert {r.text[:9] for r in html_text.main_text(spark.createDataFrame(rows, KINDS)).collect()} == {"One title"}
