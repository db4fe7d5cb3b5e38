import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score string, rank int"
DOCS = "doc_id long, text string, item string, n int"


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k=10):
    docs = [(i, words(t)) for i, t in docs if words(t)]
    total, length = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for i, w in docs:
            tf, m = Counter(w), 10 + 90 * len(w) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(words(text)) if t in tf)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, items, docs, **more):
    items = spark.createDataFrame([(*r, "x", 1) for r in items], ITEMS)
    docs = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    return sorted((tuple(r) for r in L.search(items, docs, **more).collect()), key=str)


def material(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = ["The", "of", "a-b"] * 30 + [f"w{i}é" for i in range(60)] + [f"rare{i}" for i in range(200)]
    docs = [(i * 7 % n, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(60)]  # copies: ties by id
    return [(i, "  ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 12, 60])))) for i in range(40)], docs


@pytest.mark.parametrize("small", [False, True])
def test_against_every_document(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(L, "DOCS", 7)
        monkeypatch.setattr(L, "QUERY_TERMS", 20)
        monkeypatch.setattr(L, "BITS", 1 << 15)
    items, docs = material(1)
    assert run(spark, items, docs) == brute(items, docs)
    assert run(spark, items, docs, k=1) == brute(items, docs, 1)


@pytest.mark.parametrize("seed", range(40))
def test_limited_accumulators_lose_no_document(seed):
    rng = np.random.default_rng(seed)
    docs, k = 200, 5
    lists = []
    for size in sorted(rng.integers(1, 150, rng.integers(1, 12))):  # rarest first
        lists.append((np.sort(rng.choice(docs, size, replace=False)), rng.integers(1, 2000 // size + 2, size)))
    whole = np.zeros(docs, np.int64)
    for d, s in lists:
        whole[d] += s
    found, score = L.ranked_terms(lists, docs, k)
    assert (score == whole[found]).all()
    best = np.lexsort((np.arange(docs), -whole))[:k]
    best = best[whole[best] > 0]
    assert set(best) <= set(found)


def test_frequent_terms_make_no_accumulators():
    rare = (np.arange(10), np.full(10, 1000))
    common = (np.arange(5000), np.full(5000, 1))
    made = L.ranked_terms([rare, common], 5000, 3)
    assert list(made[0]) == list(range(10)) and set(made[1]) == {1001}


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "-- !!"), (4, "one two"), (4, "one two"), (4, "three"), (None, "ONE"), (5, "nowhere"), (6, "É one")]
    docs = [(1, None), (2, ""), (3, " . "), (4, "One one TWO"), (4, "One one TWO"), (None, "one"), (None, "É"), (5, "three é " * 5000), (-1, "one")]
    assert run(spark, items, docs) == brute(items, docs)
    assert run(spark, [], docs) == [] and run(spark, items, []) == [] and run(spark, items[:3], docs) == []
