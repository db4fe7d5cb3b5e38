import random

import pytest
import xxhash
from conftest import SF

from tickloom.llm import simhash
from tickloom.llm.common import table

SCHEMA = "doc_id long, text string, fp string, component_id int"


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labelled(items):
    """id -> smallest id reachable, over all pairs; items are (id, fingerprint)."""
    root = {i: i for i, _ in items}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in items}


def check(spark, rows, **kw):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    fps = [(i, fingerprint(t)) for i, t, *_ in rows]
    want = labelled(fps)
    assert sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == sorted((i, f, want[i]) for i, f in fps)


def test_all_documents_against_every_pair(spark):
    check(spark, [(r["doc_id"], r["text"], "x", 1) for r in table(spark, SF, "documents").select("doc_id", "text").collect()])


def test_odd_texts(spark):
    long = " ".join(f"wörd{i}" + "x" * (i % 40) for i in range(3000))
    texts = [None, "", " \t\n", "One", "one two", "ONE  two\x0bthree", "one two three", "é\xa0ü ß", long, long, long + " end"]
    check(spark, [(i, t, "", 0) for i, t in enumerate(texts)])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a", "", 0), (None, "b", "", 0), (3, "a", "", 0), (3, "a", "", 0)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (3, 3)]


def test_pieces_of_a_long_text_give_its_fingerprint(monkeypatch):
    text = " ".join(random.Random(2).choices(["ab", "cde", "f", "ghijkl"], k=900))
    whole = list(simhash._fingerprints(iter([text]), 3))[0]
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert list(simhash._fingerprints(iter([text]), 3))[0] == whole == fingerprint(text)


def test_masks_cover_every_set_of_three_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    rnd = random.Random(0)
    for _ in range(20000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
        assert any(not m & diff for m in masks)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_large_buckets_keep_every_link(spark, bucket):
    """Chains and clouds around a few centres; with bucket=3 most go through shared neighbours."""
    rnd = random.Random(3)
    fps = set()
    for centre in (0, 0x0F0F00FF12345678, 2**63 + 5):
        fps |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(40)}
    items = [(simhash._signed(f), f) for f in fps]
    edges = simhash.links(spark.createDataFrame([(i,) for i, _ in items], "fp long"), bucket=bucket)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = labelled(items)
    assert {i: root.get(i, i) for i, _ in items} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 301)}
