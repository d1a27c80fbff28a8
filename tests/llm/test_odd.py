"""Odd tables for every training-data operator: nothing, nulls, empty and very long texts, repeated rows and ids, clashing columns."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraline.llm import bpe, quality_rules, queries, rule_ensemble, secrets, simhash, substrings, token_counts, topk

LONG = "a long text, " * 40_000
ROWS = [(1, "some words here"), (1, "some words here"), (1, "other words"), (None, None), (2, ""), (3, None), (4, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    clash = {c: F.lit(f"own {c}") for c in ("ids", "decoded", "n_tokens", "found", "score", "fp", "kept", "host_rate", "_w", "_l", "_host", "kinds", "part")}
    return spark.createDataFrame([(i, t, "en", None if i is None else "src1") for i, t in ROWS], "doc_id long, text string, lang string, source string").withColumns(clash)


def texts(df, *columns):
    return sorted(((r.text, *[r[c] for c in columns]) for r in df.collect()), key=str)


def test_encoding(odd):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = bpe.encode_decode(odd, path)
    assert [(t or "") for t, _ in texts(got, "decoded")] == [d for _, d in texts(got, "decoded")]
    assert got.where("fp <> 'own fp'").count() == 0 and bpe.encode_decode(odd.limit(0), path).count() == 0


def test_counts_of_whole_texts(odd, monkeypatch):
    """Pre-tokens by the pattern and tokens by the cheapest cut of each, also with a worker that forgets."""
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    with open(path) as f:
        content = f.read()
    costs = token_counts.piece_costs(content)

    def pieces(token):
        best = [(0, 0)]
        for end in range(1, len(token) + 1):
            best.append(min((best[s][0] + costs[token[s:end]], best[s][1] + 1) for s in range(end) if token[s:end] in costs))
        return best[-1][1]

    rng = random.Random(1)
    words = ["a", "the", "don't", "été", "x1", "...", "ing", "  ", "\n", "\t", "a\nb"]
    said = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for nodes in (1_500_000, 5):
        monkeypatch.setattr(token_counts, "MAX_NODES", nodes)
        counter = token_counts.Counter(content)
        for t in said:
            tokens = bpe.pre_token_pattern().findall(t)
            assert counter.text(t) == (len(tokens) << 32) + sum(pieces(x.encode()) for x in tokens)
    got = token_counts.token_counts(odd, path)
    assert got.where("n_tokens = 0").count() == 3 and got.where("score <> 'own score'").count() == 0
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    size = max(len(text), 1)
    return {
        "log_words": np.log1p(len(words)), "distinct_share": len(set(words)) / max(len(words), 1), "word_length": sum(map(len, words)) / max(len(words), 1),
        "symbol_share": sum(c in "#*$%&|<>" for c in text) / size, "upper_share": sum(c.isupper() for c in text) / size, "mark_share": sum(c in "!?" for c in text) / size,
        "digit_share": sum(c in "0123456789" for c in text) / size, "dup_line_share": 1 - len(set(lines)) / max(len(lines), 1),
    }


def test_rule_ensemble_in_plain_python(spark, odd):
    """The compiled column against rules that are looked at one by one, and rows that nothing is learnt from."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(40, 80))) if i % 3 else "bad ### !! " * rng.randint(20, 60)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(5, None), (None, 1), (999, 0)], "doc_id long, quality int")
    e = rule_ensemble.fit(docs, labels, trees=5)
    for r in rule_ensemble.scored(docs.unionByName(odd.select("doc_id", "text")), e).collect():
        stats = plain_statistics(r.text)
        total = e.intercept + sum(w for rule, w in e.weights if all(stats[s] <= t if op == "<=" else stats[s] > t for s, op, t in rule.conditions))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    turned = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_ensemble.fit(docs, turned, trees=5) == e
    got = rule_ensemble.scored(odd, e)
    assert {type(r.score) for r in got.collect()} == {float} and rule_ensemble.scored(odd.limit(0), e).count() == 0
    few = rule_ensemble.fit(docs, labels, trees=5, max_rows=60)
    assert few.weights != () and rule_ensemble.fit(docs.limit(0), labels).weights == ()


def test_paths_become_rules():
    tree = "x\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 0.0\n   Else (feature 1 <= 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   If (feature 0 <= 3.0)\n    Predict: 1.0\n   Else (feature 0 > 3.0)\n    Predict: 0.0\n"
    a, b = rule_ensemble.STATISTICS[:2]
    want = {((a, "<=", 1.5),), ((a, "<=", 1.5), (b, ">", 2.0)), ((a, "<=", 1.5), (b, "<=", 2.0)), ((a, ">", 1.5),), ((a, "<=", 3.0), (a, ">", 1.5)), ((a, ">", 3.0),)}
    assert {tuple(sorted(r.conditions)) for r in rule_ensemble.rules_of(tree)} == {tuple(sorted(x)) for x in want}


@pytest.mark.parametrize("most", [200_000, 0])
def test_secret_scans(spark, odd, monkeypatch, most):
    """By broadcast and by shuffle; overlapping spans are one in the redacted text; an index is read again."""
    monkeypatch.setattr(secrets, "MAX_BROADCAST_CANDIDATES", most)
    text = "token=AKIA" + "A" * 16 + " and " + "0f" * 12 + " " + LONG
    df = odd.unionByName(spark.createDataFrame([(7, text), (None, "password: abcdef0")], "doc_id long, text string"), allowMissingColumns=True)
    index = secrets.indexed(df)
    got = secrets.scan(df, index=index)
    found = {r.doc_id: r for r in got.select("doc_id", secrets.spans_text("found").alias("s"), secrets.redacted(F.col("text"), F.col("found")).alias("t")).where("s <> ''").collect()}
    assert found[7].s == "assign:0:26,access:6:26,hex:31:55" and found[7].t.startswith("[SECRET] and [SECRET] a long")
    assert found[None].s == "assign:0:17" and got.count() == len(ROWS) + 2 and "kinds" in got.columns
    assert secrets.scan(df.limit(0)).count() == 0


def test_search_in_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "CHUNK", 7)
    monkeypatch.setattr(topk, "MAX_TASKS", 5)
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, size=(150, 5)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9, v[3].tolist()), (300, []), (301, None), (None, [1.0] * 5), (302, [1.0, 2.0])]
    asked = [(i, v[i].tolist()) for i in range(0, 150, 11)] + [(9, v[3].tolist()), (500, [9.0] * 5), (501, [1.0, 1.0])]
    kinds = "vec_id long, v array<double>"
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, kinds), spark.createDataFrame(asked, kinds), 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    first = {}
    for i, q in sorted(asked, key=lambda x: (x[0], x[1])):
        first.setdefault(i, q)
    want = {}
    for i, q in first.items():
        scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if j is not None and x and j != i and len(x) == len(q))
        want[i] = [(j, int(-s)) for s, j in scores[:4]]
    assert dict(got) == want
    nothing = spark.createDataFrame([], kinds)
    assert topk.top_k(nothing, spark.createDataFrame(asked, kinds)).count() == 0 and topk.top_k(spark.createDataFrame(rows, kinds), nothing).count() == 0


def test_substrings_of_odd_rows(odd):
    got = substrings.without_repeats(odd).collect()
    assert len(got) == len(ROWS) and sum(r.n_bytes for r in got) == sum(len(t or "") for _, t in ROWS)
    long = next(r for r in got if r.doc_id == 4)
    assert len(long.kept) == 13 + 99 - 13 + 13 or len(long.kept) < 200  # only the first period and what can't repeat stays
    assert substrings.without_repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_hosts_are_judged(spark, odd, monkeypatch, most):
    """Rejected, trusted and in between, with verdicts by broadcast and by a join."""
    monkeypatch.setattr(quality_rules, "MAX_BROADCAST_HOSTS", most)
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    signs = lambda i: " ".join(f"w{i}x{k} ###" for k in range(60))
    rows = [(i, good(i) if i % 10 else "short", "bad" if i < 10 else "fine") for i in range(0)]
    rows += [(i, "short" if i % 10 else good(i), "bad") for i in range(40)]
    rows += [(100 + i, good(i) if i else signs(i), "fine") for i in range(400)]
    rows += [(1000 + i, signs(i) if i % 5 == 0 else good(i), "mixed") for i in range(100)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    hosts = defaultdict(list)
    for i, t, h in rows:
        hosts[h].append(got[i].base_failed or got[i].soft_failed)
    n, k = len(rows), sum(map(sum, hosts.values()))
    mean, square = k / n, sum(len(x) * (sum(x) / len(x)) ** 2 for x in hosts.values()) / n
    strength = min(1000.0, max(1.0, mean * (1 - mean) / (square - mean * mean) - 1))
    for i, t, h in rows:
        rate = (sum(hosts[h]) + mean * strength) / (len(hosts[h]) + strength)
        assert got[i].host_rate == pytest.approx(rate)
        assert got[i].kept == (not got[i].base_failed and rate <= 0.5 and (not got[i].soft_failed or rate < 0.02))
    assert not got[10].kept and got[100].kept and not got[1000].kept and got[1001].kept
    again = quality_rules.judge(odd)
    assert again.count() == len(ROWS) and again.where("`_w` <> 'own _w' or `_l` <> 'own _l' or `_host` <> 'own _host'").count() == 0


def test_fingerprints_and_components(spark, odd):
    """Against shingles, hashes and links in plain Python."""
    import xxhash

    rng = random.Random(4)
    base = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(60):
        words = base[: rng.choice([0, 2, 4, 60, 199])]
        if words and rng.random() < 0.5:
            words = words[:-1] + [f"other{i}"]
        rows.append((1000 - i, "  ".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    rows += [(7, "ÄÖ ß\x0bx y"), (8, None)]

    def fingerprint(t):
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in rows}
    part = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    part[a] = part[b] = min(part[a], part[b])
    got = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == prints and {r.doc_id: r.component_id for r in got} == part
    assert simhash.near_duplicate_groups(odd).count() == len(ROWS) and simhash.near_duplicate_groups(odd.limit(0)).count() == 0


HOSTILE = {
    "assign": "token = " * 120_000, "access": "AKIA" + "AB1 AKIA" * 120_000, "hex": "0123456789abcdefg" * 60_000, "pem": "-----BEGIN " + "ABC " * 250_000 + "x PRIVATE KEY-----", "pem2": "-----BEGIN " * 90_000,
    "github": "ghp_" + "a1" * 17 + "_gho_" * 200_000, "slack": "xoxb-" * 190_000 + "!" , "google": "AIza-" * 190_000, "jwt": "eyJ" * 330_000, "jwt2": "eyJ0123456789." * 70_000,
}


def test_no_text_makes_a_rule_crash_or_crawl(spark):
    """A megabyte against each rule, and two hundred thousand secrets in one text, with overlapping kinds."""
    many = " ".join(f"token=abc{i:06d} é" for i in range(200_000))
    rows = [(i, t) for i, t in enumerate([*HOSTILE.values(), many, "token=" + "0a" * 20 + " AKIA" + "B" * 20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = secrets.scan(docs).select("doc_id", "text", "found", secrets.redacted(F.col("text"), F.col("found")).alias("clean")).collect()
    assert time.time() - began < 120
    for r in got:
        want = []
        for place, rule in enumerate(secrets.RULES[:3]):
            want += [(m.start(), place, m.end(), rule.kind) for m in re.finditer(rule.pattern, r.text) if not rule.group or len(m[rule.group]) >= rule.least]
        assert [tuple(s) for s in r.found if s.place < 3] == sorted(want)
        assert r.clean == plain_redacted(r.text, r.found)
    assert next(len(r.found) for r in got if r.text == many) == 200_000


def plain_redacted(text, found):
    out, at = [], 0
    for s in found:
        if s.start >= at:
            out += [text[at : s.start], "[SECRET]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_a_null_id_is_before_the_smallest_id(spark):
    said = " ".join(f"word {k}" for k in range(30))
    rows = [(-(2**63), said), (None, said), (None, said + "and more"), (-(2**63), said)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(((r.doc_id is not None, len(r.kept)) for r in got))
    assert sum(n for _, n in kept) < len(said) + len("and more") + 1 and max(n for known, n in kept if known) == 0 and max(n for known, n in kept if not known) == len(said)
