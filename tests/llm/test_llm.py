"""Training-data operators against brute force on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraline.llm import bpe, html_text, mixing, quality_rules, queries, rule_ensemble, secrets, simhash, substrings, token_counts, topk

ODD = [(1, "a b"), (2, None), (None, ""), (3, "x" * 3000), (4, "a b"), (4, "a b"), (5, "é\x1c  \n\n 𝒳 don't<|endoftext|>z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "src1", 0, "clash") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, ids string")


def test_bpe_matches_the_library(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    got = bpe.encode_decode(odd, queries.vocabulary("byte_bpe_50k.json")).select("text", "ids", "decoded").collect()
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.decode(spark.createDataFrame([([72, 999999],), (None,)], "ids array<int>"), queries.vocabulary("byte_bpe_50k.json")).select("decoded").collect()[1][0] == ""


def test_token_counts_are_cheapest_cuts(odd):
    with open(queries.vocabulary("byte_bpe_50k.tiktoken")) as f:
        counter = token_counts.Counter(f.read())
    costs = counter.trie.costs

    def brute(token):
        best = [(0, 0)]
        for end in range(1, len(token) + 1):
            best.append(min((best[s][0] + costs[token[s:end]], best[s][1] + 1) for s in range(end) if token[s:end] in costs))
        return best[-1][1]

    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("thenaioué") for _ in range(rng.randint(1, 14))).encode()
        assert counter.trie.count_of(w) == brute(w)
    assert token_counts.token_counts(odd, queries.vocabulary("byte_bpe_50k.tiktoken")).where("n_tokens = 0").count() == 2


def test_rule_ensemble(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(60)) if i % 3 else "bad ### " * 40) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    e = rule_ensemble.fit(docs, labels, trees=4)
    got = rule_ensemble.scored(docs, e).select("doc_id", "score", rule_ensemble.held_out(F.col("doc_id")).alias("h")).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in got) and any(r.h for r in got)
    assert rule_ensemble.fit(docs, labels.limit(0)).weights == ()


def test_secrets(spark, odd):
    text = "password = token : \"abcdefgh\" é api_key='zzz999' Token==abcdef " + "0a" * 12
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(secrets.spans_text("found").alias("s"), secrets.redacted(F.col("text"), F.col("found")).alias("t")).first()
    assert r.s == "assign:32:47,assign:49:62,hex:63:87" and r.t.startswith('password = token : "abcdefgh" é [SECRET]')
    assert secrets.scan(odd).count() == len(ODD) and secrets.scan(odd.limit(0)).count() == 0
    assert secrets.trigram_query("[0-9]+") == [] and secrets.trigram_query("AKIA[0-9]+") == [frozenset({"aki", "kia"})]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(400, 12)), 1).astype(float) * 0.1
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [float("nan")] * 12), (1002, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.quantised(F.col("e")).alias("v"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    q = np.floor(256 * v)
    for i in range(0, 400, 50):
        s = q @ q[i]
        want = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:5]
        assert [got[i][k] for k in range(1, 6)] == [(j, int(s[j])) for j in want]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_other_queries(spark):
    """Queries that are no rows of the vectors, closer to each other than to any row."""
    kinds = "vec_id long, v array<double>"
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], kinds)
    asked = spark.createDataFrame([(100 + i, [1000.0 + i, 0.0]) for i in range(8)] + [(3, [2000.0, 0.0])], kinds)
    got = {(r.query_id, r.rank): r.vec_id for r in topk.top_k(rows, asked, 3).collect()}
    assert got == {(q, k): v for q in range(100, 108) for k, v in ((1, 7), (2, 6), (3, 5))} | {(3, 1): 7, (3, 2): 6, (3, 3): 5}


def test_suffix_order():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 40))] + [-1]
        assert substrings.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("cap", [50_000, 3])
def test_substrings(spark, monkeypatch, cap):
    monkeypatch.setattr(substrings, "MAX_GROUP", cap)
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passages = [text(rng.randint(20, 60)) for _ in range(4)] + ["x" * 150]
    rows = [(i, text(rng.randint(0, 20)) + "".join(rng.choice(passages)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 2)))) for i in range(40)]
    rows += [(200, None), (201, ""), (None, rows[3][1]), (202, "y" * 500), (202, "y" * 300), (5, rows[7][1])]
    first, want = set(), []
    for i, t in sorted(((-(2**63) if i is None else i), t or "") for i, t in rows):
        b = t.encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in first:
                covered[s : s + 100] = b"\1" * 100
            first.add(b[s : s + 100])
        want.append((i, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.sha2("kept", 256).alias("h")).collect()
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, r.h) for r in got) == sorted(want)


def test_quality_rules(spark, odd):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a"), (2, "the cat sat " * 30, "a"), (3, f"{words}\n{words}", "a"), (4, None, None)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (60, 0, False)
    assert got[2].n_repeat_words == 90 and got[2].base_failed and not got[2].kept
    assert (got[3].n_dup_lines, got[3].n_repeat_words) == (1, 120) and got[4].n_words == 0
    assert quality_rules.judge(odd).count() == len(ODD) and quality_rules.judge(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 2 else "fr", f"src{i % 3}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    n = docs.count()
    whole = mixing.mix(docs, share=1.0, max_epochs=1).collect()
    assert len(whole) == n and all(r.n_copies == 1 for r in whole)
    half = mixing.mix(docs, share=0.5, max_epochs=1, weights={"lang": {"en": 3}}).withColumn("t", F.size(quality_rules.words_of(F.col("text")))).groupBy("lang").agg(F.sum("t").alias("t")).collect()
    total = sum(1 + i % 7 for i in range(120))
    assert sum(r.t for r in half) <= total * 0.5 and {r.lang: r.t for r in half}["en"] > {r.lang: r.t for r in half}["fr"]
    assert mixing.mix(odd).count() > 0 and mixing.mix(odd.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [20_000, 4])
def test_simhash(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "MAX_BUCKET", cap)
    rng = random.Random(6)
    fps = set()
    for _ in range(5):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for k in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << k
            fps.add(x - (1 << 64) if x >> 63 else x)
    from terraline.operators.graph import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")), "a", "b").collect()}
    part = {x: x for x in fps}
    for _ in range(10):
        for a in fps:
            for b in fps:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    part[a] = part[b] = min(part[a], part[b])
    assert {x: got.get(x, x) for x in fps} == part


def test_simhash_odd_rows(odd):
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(odd).collect()}
    assert (4, 1) in groups and (2, 2) in groups and (None, 2) in groups
    assert simhash.without_near_duplicates(odd).count() == 4 and simhash.without_near_duplicates(odd.limit(0)).count() == 0


def test_html(spark):
    pages = ["<nav>m</nav><article><h1>T&amp;</h1><p>a<b>b</b><br>c<!-- x --><section class='comments'>no</section></article><footer>f</footer>", None, "", "a < b", "<script>x</script><p>one<p>two <div class=ad>z</div>"]
    got = [r.text for r in html_text.main_text(spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == ["T&\n\nab c", "", "", "a < b", "one\n\ntwo"]
    menu = [(i, "http://s.example/x", f"<div><span>same words</span></div><div><p>text {i}</p></div>") for i in range(12)]
    low = html_text.style_tree(spark.createDataFrame(menu, "page_id long, url string, html string")).where("importance < 0.1").count()
    assert low == 1
    assert {r.text for r in html_text.main_text(spark.createDataFrame(menu, "page_id long, url string, html string")).collect()} == {f"text {i}" for i in range(12)}


def test_html_copies(spark):
    """A host's copies neither empty their own texts nor those of its other pages, and its boilerplate still goes."""
    whole = lambda t: f"<html><body><div class=page><article><p>{t}</p><div class=end>read on</div></article></div></body></html>"
    plain = lambda t: f"<div><span>same words</span></div><div><p>{t}</p></div>"
    rows = [("equal", whole("one text of a host with mirrors"))] * 10 + [("equal-plain", plain("one text"))] * 10
    rows += [("most", whole("the text that is copied"))] * 950 + [("most", whole(f"text number {i} of the others")) for i in range(50)]
    rows += [("plain", plain("copied"))] * 950 + [("plain", plain(f"other {i}")) for i in range(50)]
    rows += [("near", whole(f"the same long text</p><i>{i}</i><p>")) for i in range(20)]
    pages = spark.createDataFrame([(i, f"http://{h}.example/", t) for i, (h, t) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    at = lambda host: [got[i] for i, (h, _) in enumerate(rows) if h == host]
    assert at("equal") == ["one text of a host with mirrors\n\nread on"] * 10 and at("equal-plain") == ["same words\n\none text"] * 10
    assert at("most") == ["the text that is copied"] * 950 + [f"text number {i} of the others" for i in range(50)]
    assert at("plain") == ["copied"] * 950 + [f"other {i}" for i in range(50)]
    assert at("near") == [f"the same long text\n\n{i}\n\nread on" for i in range(20)]


@pytest.mark.parametrize("frequent", [100_000, 0])
def test_near_copies_at_a_similarity(spark, monkeypatch, frequent):
    """Groups against brute force over sets of 5-word shingles, with pairs beyond 4 bits and a line that many share."""
    from terraline.llm import similar_sets

    monkeypatch.setattr(similar_sets, "FREQUENT", frequent)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(30)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([40, 100, 220]))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words[: rng.randint(9 * len(words) // 10, len(words))] + (line if rng.random() < 0.3 else []))))
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    prints = [simhash.majority(simhash.shingle_hashes(t, 5)) for _, t in rows]
    part, far = list(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                far += ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() > 4
                x, y = part[i], part[j]
                part = [min(x, y) if p in (x, y) else p for p in part]
    got = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=4)
    assert far > 10 and {r.doc_id for r in got.collect()} == set(part)


def test_sketches_grow_with_sets():
    """The sketch's bound leaves out unlike pairs of large sets as well, and no similar pair, whatever lengths their sketches have."""
    import numpy as np

    from terraline.llm import similar_sets

    rng = np.random.default_rng(5)
    some = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))

    def able(a, b):
        x, y = similar_sets._folded([similar_sets._sketch(a), similar_sets._sketch(b)])
        lost = [int(np.bitwise_count(v).sum()) for v in (x & ~y, y & ~x)]
        return 9 * min(len(a) - lost[0], len(b) - lost[1]) >= 4 * (len(a) + len(b))

    for n in (500, 1500, 2000, 6000, 20_000):
        a = some(n)
        assert not able(a, some(n)) and not able(a, some(n * 6 // 5))
        more = np.union1d(a, some(n // 5))
        assert similar_sets.similar(a, more) and able(a, more) and able(a[: n * 9 // 10], a)


@pytest.mark.parametrize("elements", [1_000_000, 3_000])
def test_families_below_the_similarity(spark, monkeypatch, elements):
    """Copies of a text that are about 0.8 alike have the groups of brute force, in one block of sets or in several."""
    from terraline.llm import similar_sets

    monkeypatch.setattr(similar_sets, "ELEMENTS", elements)
    rng, rows = random.Random(31), []
    for family in range(2):
        old = [f"w{family}x{k}" for k in range(260)]
        for _ in range(50):
            said = list(old)
            for at in rng.sample(range(0, 260, 6), rng.choice([2, 3, 4, 4, 4])):
                said[at] = f"n{rng.random()}"
            rows.append((len(rows), 0, " ".join(said)))
    sets, part, near = [set(simhash.shingle_hashes(r[2], 5)) for r in rows], list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            near += 7 * len(sets[a] | sets[b]) < 10 * len(sets[a] & sets[b]) < 8 * len(sets[a] | sets[b])
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = part[a], part[b]
                part = [min(x, y) if p in (x, y) else p for p in part]
    got = {r.doc_id: r.part for r in similar_sets.groups(spark.createDataFrame(rows, "doc_id long, _row long, text string"), 5, 4).collect()}
    assert near > 500 and len(set(part)) > 4
    assert len({(part[i], got[i]) for i in got}) == len(set(part)) == len(set(got.values()))


def test_a_family_makes_no_row_for_a_pair():
    """The last step links a bucket's sets that its bounds can't tell apart by fewer rows than it has sets, and whole sets tell
    which of them are similar."""
    import numpy as np
    import pyarrow as pa

    from terraline.llm import similar_sets

    rng = np.random.default_rng(7)
    some = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    base = some(400)
    sets = [np.union1d(rng.choice(base, 370, replace=False), some(30)) for _ in range(200)] + [some(400) for _ in range(50)]
    sets += [np.union1d(sets[3], some(20)), np.union1d(sets[4], some(60)), some(1500)]
    n, cls = [len(x) for x in sets], list(range(len(sets)))
    rows = [(key, c, n[c], c, similar_sets._sketch(sets[c])) for key in range(5) for c in cls] + [(9, 3, n[3], 3, similar_sets._sketch(sets[3])), (9, 250, n[250], 250, similar_sets._sketch(sets[250]))]
    kinds = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("part", pa.int64()), ("sketch", pa.binary())])
    batches = pa.Table.from_arrays([pa.array(x) for x in zip(*rows)], names=kinds.names).cast(kinds).to_batches(max_chunksize=97)
    links = [tuple(r.values()) for b in similar_sets._forest(batches) for r in b.to_pylist()]
    up = {c: c for c in cls}
    for a, b in links:
        up = {c: up[a] if p == up[b] else p for c, p in up.items()}
    assert 100 < len(links) < len(sets) and up[3] == up[250] and up[4] == up[251]
    similar = {(a, b) for a in cls for b in range(a) if similar_sets.similar(sets[a], sets[b])}
    assert {(250, 3), (251, 4)} <= similar and all(up[a] == up[b] for a, b in similar)
    for block in (np.zeros(len(cls), int), np.array(cls) % 2):
        found = similar_sets._joining(block, np.array(cls), np.array(cls), sets)
        assert {(max(x), min(x)) for x in found} == {(a, b) for a, b in similar if block[0] == block[-2] == block[1] or a % 2 != b % 2}
    assert not similar_sets._joining(np.zeros(len(cls), int), np.array(cls), np.zeros(len(cls), int), sets)
