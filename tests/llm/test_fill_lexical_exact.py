"""Fill-in-middle, ranked lexical search and exact dedup against plain Python, odd tables included."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraline.llm import exact_dedup, fill_middle, lexical, queries
from terraline.session import run_folder

LONG = "a long text, " * 40_000
CLASH = ("n", "form", "output", "prefix_chars", "digest", "kept", "keep_id", "term", "segment", "score", "rank", "batch")


def odd(spark):
    rows = [(1, "Some words <here>"), (1, "Some words <here>"), (1, "other words"), (None, None), (2, ""), (3, None), (4, LONG), (5, "has <S> in it"), (6, "é𝒳"), (7, "SOME words <HERE>"), (-8, "\n<P"), (None, "é𝒳")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in CLASH})


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def random_texts(seed, many):
    rng = random.Random(seed)
    pieces = ["ab", "Zz", " ", "é", "𝒳", "\n", "<", ">", "P", "<S", "M>", "<M>", "9", "", "́", "<P"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(many)]


def test_fill_in_middle_is_what_plain_python_says(spark):
    rows = list(enumerate(random_texts(3, 700)))
    docs = odd(spark).unionByName(spark.createDataFrame([(i, t, *["own"] * len(CLASH)) for i, t in rows], ["doc_id", "text", *CLASH]))
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) + 12 and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fill(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.digest.startswith("own")
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 17, 1 << 20])
def test_the_kernel_is_the_same_for_every_slice(size, monkeypatch):
    """Texts that end in the next one's letters, in slices of one text, of few and of all, from an array with an offset."""
    texts = pa.array(["cut off", *random_texts(4, 300), "", "abc", "def", "", "<S", ">", "M>"], pa.large_string())[1:]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    drawn = np.array([[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i in range(len(texts))])
    monkeypatch.setattr(fill_middle, "SLICE", size)
    at = 0
    for a, b in fill_middle._slices(offsets):
        assert a == at
        n, form, prefix, middle, body, ends = fill_middle.transform(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], drawn[a:b], 10, 20)
        for k in range(b - a):
            want = plain_fill(a + k, texts[a + k].as_py())
            assert (int(n[k]), ("plain", "psm", "spm")[form[k]], body[ends[k] : ends[k + 1]].tobytes().decode()) == (want[0], want[1], want[4])
            assert form[k] == 0 or (int(prefix[k]), int(middle[k])) == want[2:4]
        at = b
    assert at == len(texts)


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    many, total = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in held:
            m = 50 + 50 * c.total() * many // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score:
                scored.append((-score, i is not None, i or 0, i, score))
        out += [(item, rank, s[3], s[4]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 128])
def test_search_gives_the_exact_best(spark, monkeypatch, block):
    """Copies that tie beyond k, hot words, repeated ids and items, and a term that is many documents' own."""
    rng = random.Random(5)
    words = [f"w{x}" for x in range(60)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([3, 60])]) for _ in range(rng.randint(1, 90)))) for i in range(400)]
    docs += [(1000 - i, "w1 W2, w3! same copy") for i in range(150)] + [(None, "w1 w2"), (None, "w5"), (7, "w5 é_É"), (3000, "w9 " * 5000), (3001, None), (3002, "...")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(40)] + [(100, "w1 w2 w3 same copy"), (101, "unknown"), (102, None), (None, "é w5"), (None, "É"), (103, "w9"), (103, "w9 w1")]
    monkeypatch.setattr(lexical, "BLOCK", block)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    index = lexical.build(table)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    for k in (3, 50):
        got = [tuple(r) for r in lexical.search(index, asked, k).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=str) == plain_search(docs, items, k)
    assert lexical.search(lexical.build(table.limit(0)), asked).count() == 0 and lexical.search(index, asked.limit(0)).count() == 0
    monkeypatch.setattr(lexical, "MAX_BROADCAST_TERMS", 5)
    got = [tuple(r) for r in lexical.search(index, asked, 50).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == plain_search(docs, items, 50)


def test_bounds_hold():
    """A byte's step is never below the exact share, and one less is never above."""
    tf, m = np.meshgrid(np.array([1, 2, 3, 10, 500, 10**6]), np.array([50, 51, 99, 100, 1000, 10**7]))
    s = lexical.shares(tf.astype(np.int64), m.astype(np.int64))
    steps = -(-s // lexical.STEP)
    assert (steps * lexical.STEP >= s).all() and ((steps - 1) * lexical.STEP <= s).all() and steps.max() <= 255


def plain_groups(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    best = {g: max(ids, key=lambda i: (i is not None, i or 0)) for g, ids in groups.items()}
    return sorted(((i, best[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("heavy", [3, 100_000])
def test_exact_dedup(spark, monkeypatch, heavy):
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + i, "Hot ÄÖ" if i % 2 else f"t{i % 50}", *["own"] * len(CLASH)) for i in range(300)], ["doc_id", "text", *CLASH]))
    index = exact_dedup.open_index(spark, f"{run_folder(spark)}/index-{heavy}")
    found = exact_dedup.verdicts(docs, index, "first")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got), key=str) == plain_groups(rows)
    kept = [r.digest for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.digest for r in got}) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.without_copies(docs, found)
    assert left.columns == docs.columns and left.count() == len(kept) and left.where("form <> 'own form' and form <> 'own'").count() == 0
    none = exact_dedup.verdicts(docs.limit(0), exact_dedup.open_index(spark, f"{run_folder(spark)}/empty-{heavy}"), "x")
    assert none.count() == 0


def test_later_batches_meet_the_index(spark):
    """What earlier batches hold goes; a batch that is run again says the same; another session opens the folder."""
    folder = f"{run_folder(spark)}/index-batches"
    index = exact_dedup.open_index(spark, folder, buckets=5)
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one, two = batch([(1, "a"), (2, "A"), (3, "b")]), batch([(9, "B"), (10, "c"), (11, "C"), (12, "a")])
    said = lambda df: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    first = said(exact_dedup.verdicts(one, index, "one"))
    assert first == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    second = said(exact_dedup.verdicts(two, index, "two"))
    assert second == [(9, 3, 1, False), (10, 11, 2, False), (11, 11, 2, True), (12, 2, 1, False)]
    assert said(exact_dedup.verdicts(two, index, "two")) == second and said(exact_dedup.verdicts(one, index, "one")) == first
    spark.sql(f"drop table {index.table}")
    again = exact_dedup.open_index(spark, folder)
    assert again.buckets == 5 and sorted((r.keep_id, r.batch) for r in again.rows(spark).collect()) == [(2, "one"), (3, "one"), (11, "two")]
    side = two.select(exact_dedup.digest(F.col("text")).alias("digest")).repartition(5, "digest").hint("merge")
    plan = side.join(again.rows(spark).select("digest"), "digest", "left_anti")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_no_python_in_exact_dedup(spark):
    plan = queries.op13_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
