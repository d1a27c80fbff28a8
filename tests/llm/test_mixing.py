"""Budgets, prefixes and whole mixes against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terraline.llm import mixing

DOCS = "doc_id long, text string, lang string, source string"


def split(total, children):
    """Whole shares of (name, capacity, weight): fills the full ones one by one until none is."""
    got, left = {}, list(children)
    while left:
        weights = sum(w for *_, w in left)
        full = [c for c in sorted(left, key=lambda c: (c[1] / c[2], c[0] is not None, c[0] or "")) if c[1] * weights <= total * c[2]][:1]
        if not full:
            break
        got[full[0][0]] = full[0][1]
        total -= full[0][1]
        left.remove(full[0])
    weights, over = sum(w for *_, w in left), total
    for name, _, w in left:
        got[name] = total * w // weights
        over -= got[name]
    for name, *_ in sorted(left, key=lambda c: (c[1] / c[2], c[0] is not None, c[0] or ""))[: max(0, over) if left else 0]:
        got[name] += 1
    return got


def budgets(leaves, total, epochs, weights):
    weight = lambda level, name: weights.get(level, {}).get(name, 1)
    usable = {k: n * epochs for k, n in leaves.items() if n > 0 and all(weight(level, k[i]) > 0 for i, level in enumerate(mixing.LEVELS))}

    def down(prefix, total):
        depth = len(prefix)
        if depth == 3:
            return {prefix: total}
        names = {k[depth] for k in usable if k[:depth] == prefix}
        children = [(n, sum(c for k, c in usable.items() if k[: depth + 1] == (*prefix, n)), weight(mixing.LEVELS[depth], n)) for n in names]
        return {k: b for n, t in split(total, children).items() for k, b in down((*prefix, n), t).items()}

    return {k: 0 for k in leaves} | (down((), total) if usable else {}), sum(usable.values())


@pytest.mark.parametrize("seed", range(4))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    leaves = {}
    for _ in range(25):
        leaves[rng.choice("ABC"), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None])] = rng.choice([0, 1, 7, 50, 400, 10**15])
    weights = {"domain": {"A": 3, "C": rng.choice([0, 2])}, "lang": {"fr": rng.choice([0, 5])}, "source": {"s2": 0, "s3": 10**9}}
    total, epochs = rng.choice([3, 100, 560, 3 * 10**15]), rng.choice([1, 2])
    want, capacity = budgets(leaves, total, epochs, weights)
    got = mixing.budgets(spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, tokens long"), total, epochs, weights).collect()
    assert {(r.domain, r.lang, r.source): r.budget for r in got} == want
    assert sum(want.values()) == min(total, capacity)


def brute(rows, seed, share, epochs, weights):
    n = lambda t: len(re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t or ""))
    leaf = lambda r: ("other" if not re.search(r"[0-9]+$", r[3] or "") else f"domain{int(re.search('[0-9]{1,9}$', r[3])[0]) % 4}", r[2], r[3])
    leaves, docs = defaultdict(int), defaultdict(list)
    for r in rows:
        leaves[leaf(r)] += n(r[1])
        docs[leaf(r)].append(r)
    out = []
    for k, b in budgets(leaves, int(sum(leaves.values()) * share), epochs, weights)[0].items():
        whole, rest = divmod(b, leaves[k]) if leaves[k] else (0, 0)
        by_mark = defaultdict(list)
        for r in docs[k]:
            by_mark[hashlib.md5(f"{seed}:{whole + 1}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()].append(r)
        upto = 0
        for mark in sorted(by_mark):
            upto += sum(n(r[1]) for r in by_mark[mark])
            out += [(r[0], r[1], whole + (rest > 0 and upto <= rest)) for r in by_mark[mark]]
    return sorted(((i, t, c) for i, t, c in out if c), key=str)


@pytest.mark.parametrize("share, weights", [(1.0, {}), (0.4, {"lang": {"fr": 0}}), (0.7, {"domain": {"domain1": 5}, "source": {"src2": 0}}), (3.0, {"lang": {"en": 2}})])
def test_mixes(spark, share, weights):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab", "12", "c3", "...", ""]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["src1", "src2", "src5", "x", None])) for i in range(150)]
    rows += [(7, "a repeated id", "en", "src1"), (7, "a repeated id", "en", "src1"), (None, "no id", "en", "src1"), (400, None, "en", "src1"), (401, "w " * 30_000, "de", "src9")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"domain": F.lit("clash"), "epochs": F.lit(9), "rest": F.lit(9), "_mark": F.lit("m")})
    got = mixing.mix(docs, seed=5, share=share, max_epochs=2, weights=weights)
    assert sorted(((r.doc_id, r.text, r.n_copies) for r in got.collect()), key=str) == brute(rows, 5, share, 2, weights)
    assert got.where("epochs <> 9 or rest <> 9").count() == 0 and mixing.mix(docs.limit(0)).count() == 0
