import math
import random
from collections import Counter

import numpy as np

from tickloom.llm import decontaminate as D

ITEMS = "item_id long, text string, score int"
DOCS = "doc_id long, text string, item_id string, score string"


def brute_scores(items, text, unit):
    """Best normalised BM25 score of each unit over all passages, without any index."""
    units = [(k, p) for k, (_, t) in enumerate(items) for p in D.pieces(D.words(t), unit)]
    df = Counter(t for _, p in units for t in set(p))
    n, mean = len(units), sum(len(p) for _, p in units) / len(units)
    terms = D.words(text)
    spans = [terms[a : a + 2 * unit] for a in range(0, max(1, len(terms) - unit), unit)]
    out = []
    for _, p in units:
        w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(p) / mean)) for t, f in Counter(p).items()}
        out.append(max(sum(x for t, x in w.items() if t in s) / sum(w.values()) for s in map(set, spans)))
    return out


def material():
    rnd = random.Random(5)
    vocabulary = ["the", "of", "a"] * 40 + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([2, 12, 30, 55, 130]))) + ".") for i in range(40)]
    docs = [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 3, 90, 400]))) for _ in range(60)]
    for i in range(0, 60, 3):
        w = docs[i].split()
        at = rnd.randint(0, len(w))
        docs[i] = " ".join(w[:at] + items[i % 40][1].upper().split() + w[at:])
    return items, docs


def test_retrieval_is_exhaustive_scoring(spark):
    items, docs = material()
    (index,) = D.indexes(spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS))
    for text in docs:
        terms = D.words(text)
        ids = np.array([index.term.get(t, -1) for t in terms], np.int64)
        for threshold in (0.3, 0.6):
            want = {u: s for u, s in enumerate(brute_scores(items, text, 40)) if s >= threshold - 1e-9} if terms else {}
            got = index.retrieve(ids, threshold)
            assert set(got) == set(want) and all(abs(got[u] - s) < 1e-6 for u, s in want.items())


def test_matches_are_the_contained_items(spark, monkeypatch):
    items, docs = material()
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    table = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(docs)], DOCS)
    def contained(doc, item):
        a, b = D.words(doc), D.words(item)
        k = min(5, len(b))
        return sum(1 for s in D.shingles(b, k) if s in D.shingles(a, k)) >= 0.8 * len(D.shingles(b, k))
    want = {(k, i) for k, d in enumerate(docs) for i, t in items if contained(d, t)}
    assert len(want) >= 20
    for shard in (2048, 16):
        monkeypatch.setattr(D, "SHARD", shard)
        index = D.indexes(bench)
        assert len(index) > 1 or shard == 2048
        got = D.matches(table, index).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
        kept = {r["doc_id"] for r in D.clean(table, index).collect()}
        assert kept == set(range(len(docs))) - {k for k, _ in want}


def test_long_document_and_long_item(monkeypatch):
    rnd = random.Random(1)
    item = " ".join(f"q{rnd.randint(0, 999)}" for _ in range(300))
    index = D.Index([(7, item)], Counter(t for p in D.pieces(D.words(item), 40) for t in set(p)), 8, 37.5, 40)
    monkeypatch.setattr(D, "PIECE", 200)
    text = " ".join(f"x{i}" for i in range(1530)) + " " + item + " y" * 500
    assert [m[0] for m in index.matches(text, 0.6, 0.8, 5)] == [0]
    assert index.matches(" ".join(item.split()[:200]), 0.6, 0.8, 5) == []


def test_a_question_or_an_answer_alone(spark):
    rnd = random.Random(8)
    text = lambda k: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(k))
    sizes = [(12, 11), (13, 12), (12, 60), (25, 3), (90, 30), (11, 30), (30, 12), (5, 4)]
    qa = [(text(q), text(a)) for q, a in sizes]
    bench = spark.createDataFrame([(i, f"{q}? {a}", 0) for i, (q, a) in enumerate(qa)], ITEMS)
    alone = [(10 * i + k, f"{text(70)} {part.upper()}, {text(70)}") for i, both in enumerate(qa) for k, part in enumerate(both)]
    docs = alone + [(1000 + i, f"{text(9)} {q}? {a} {text(50)}") for i, (q, a) in enumerate(qa)] + [(2000, text(300))]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    want = {(10 * i + k, i) for i, size in enumerate(sizes) for k in (0, 1) if size[k] >= 12 or size[k] - 4 >= 0.8 * (sum(size) - 4)}
    want |= {(1000 + i, i) for i in range(len(qa))}
    index = D.indexes(bench)
    assert {(r["doc_id"], r["item_id"]) for r in D.matches(table, index).collect()} == want
    assert {r["doc_id"] for r in D.clean(table, index).collect()} == {i for i, _ in docs} - {d for d, _ in want}


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "...", 0), (4, "rare", 0), (5, "What is it? blue whale", 0),
                                   (5, "What is it? blue whale", 0), (None, "one two three four five six", 0)], ITEMS)
    docs = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (3, "so RARE here", "", ""), (None, "one two three four five six", "", ""),
                                  (4, "what is it blue whale", "", ""), (4, "what is it blue whale", "", "")], DOCS)
    got = D.matches(docs, D.indexes(bench)).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in got) == [(-1, -1), (3, 4), (4, 5), (4, 5), (4, 5), (4, 5)]
    assert all(r["question_overlap"] == r["answer_overlap"] == 1.0 for r in got)
    assert D.indexes(bench.limit(0)) == [] and D.matches(docs, []).collect() == [] and D.clean(docs, []).count() == 6
    assert D.matches(docs.limit(0), D.indexes(bench)).collect() == []
