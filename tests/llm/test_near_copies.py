import itertools
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF

import corpus_pipeline as P
from tickloom.llm import near_copies as N
from tickloom.llm.common import table

DOCS = "doc_id long, text string, sid string, h int"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]


def brute(rows):
    """For each component over all pairs, the rows with its smallest id (no id comes last)."""
    def shingles(text):
        w = words_of(text)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return [{k for k in g if key(k) == min(map(key, g))} for g in groups.values()]


MEET = {"masks": np.zeros(1, np.uint32), "cutoff": 128}  # all fingerprints are candidates: what is left is exact


def check(spark, rows, **how):
    """No row goes that is not linked to one that stays; with all candidates also every row that is."""
    out = N.without_near_copies(spark.createDataFrame([(i, t, "keep", 5) for i, t in rows], DOCS), **how).collect()
    assert all(r["sid"] == "keep" and r["h"] == 5 for r in out)
    got = sorted(((r["doc_id"], r["text"]) for r in out), key=str)
    groups = brute(rows)
    for g in groups:  # of each group a row with its smallest id stays
        assert len({rows[k] for k in g} & set(got)) >= 1
    if how:
        assert len(got) == len(groups) and all(len({rows[k] for k in g} & set(got)) == 1 for g in groups)
    assert len(rows) - len(got) >= 0.9 * (len(rows) - len(groups))


def test_the_stage_against_every_pair(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = dict(P.STAGES)["simhash near-dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(rows[min(g)][0] for g in brute(rows))


def material(seed):
    rnd = random.Random(seed)
    text = lambda k: [f"w{rnd.randint(0, 3000)}" for _ in range(k)]
    line, rows = text(40), []
    bases = [text(rnd.randint(6, 120)) for _ in range(6)]
    for i in range(150):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(text(3))
        if i % 4 == 0:  # a line that many share, with too little else to differ
            w = text(rnd.randint(0, 14)) + line + text(rnd.randint(0, 4))
        rows.append((i * 7 % 150, " ".join(w)))
    return rows


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_edited_copies_and_common_lines(spark, monkeypatch, rounds):
    monkeypatch.setattr(N, "ROUNDS", rounds)
    monkeypatch.setattr(N, "SMALL", 2 if rounds == 0 else 4096)  # 2: what is left is compared by buckets
    rows = material(rounds)
    sizes = [len(g) for g in brute(rows)]
    assert 20 < len(sizes) < 140
    check(spark, rows, **MEET)
    check(spark, rows)


def test_a_copy_with_more_bits_than_the_fingerprints_allow(spark):
    w = [f"w{k}" for k in range(60)]
    copies = [(1, " ".join(w)), (2, " ".join(w[:30] + ["new"] + w[30:])), (3, " ".join(w[:20] + ["x"] + w[21:40] + ["y", "z"] + w[42:]))]
    assert [r["doc_id"] for r in dict(P.STAGES)["simhash near-dedup"](spark, spark.createDataFrame([(*r, "x", 1) for r in copies], DOCS), SF).orderBy("doc_id").collect()] == [1, 3]


def test_odd_rows(spark):
    check(spark, **MEET, rows=[(1, None), (2, ""), (3, "One"), (4, "ONE "), (5, "one two"), (6, "é\xa0ü"), (7, "long " * 60), (8, "long " * 50)])
    assert N.without_near_copies(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0), (3, " ", "", 0)], DOCS)).count() == 1
    assert N.without_near_copies(spark.createDataFrame([], DOCS)).collect() == []


def test_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " new"), (2, b), (2, b), (None, c), (None, c + " new"), (None, c), (None, "new " + a)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in dict(P.STAGES)["simhash near-dedup"](spark, df, SF).collect()]
    assert len(got) == 3 and {(1, a), (2, b)} <= set(got) and {t for i, t in got if i is None} <= {c, c + " new"}


def test_pairs_within_the_radius_of_a_part_meet():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
    for cut in range(N.CUTS):
        for part in range(4):
            flips = w.copy()
            for row in flips:
                for bit in rng.choice(32, N.RADIUS, replace=False):
                    where = 32 * part + bit if cut == 0 else 4 * bit + part
                    if cut == 0:
                        row[where // 64] ^= np.uint64(1 << (63 - where % 64))
                    else:  # bits in the order of the bytes in memory
                        row[where // 64] ^= np.packbits(np.eye(64, dtype=np.uint8)[where % 64]).view(np.uint64)[0]
            keys = list(zip(N.tables(w[:, 0], w[:, 1], N.MASKS), N.tables(flips[:, 0], flips[:, 1], N.MASKS)))
            own = keys[(cut * 4 + part) * len(N.MASKS) : (cut * 4 + part + 1) * len(N.MASKS)]
            assert np.any([a[1] == b[1] for a, b in own], axis=0).all()


def test_trees_are_the_candidates_of_each_key():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**62, (6, 2)).astype(np.uint64)
    w = np.repeat(centre, 30, axis=0)
    for row in w:
        for bit in rng.choice(128, rng.integers(0, 25), replace=False):
            row[bit // 64] ^= np.uint64(1 << (bit % 64))
    for sizes in ([180], [5] * 36, [1, 2, 15, 16, 17, 18, 40, 71]):
        key = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint32)
        shuffled = w[rng.permutation(180)]
        w0, w1 = np.ascontiguousarray(shuffled[:, 0]), np.ascontiguousarray(shuffled[:, 1])
        root, want = N.trees(key, w0, w1, 32), np.arange(180)
        before = None
        while before is None or (before != want).any():
            before = want.copy()
            for i in range(180):
                near = (key == key[i]) & (np.bitwise_count(w0 ^ w0[i]).astype(int) + np.bitwise_count(w1 ^ w1[i]) <= 32)
                want[i] = want[near].min()
        assert len(set(zip(root, want))) == len(set(root)) == len(set(want))


def test_few_pairs_where_documents_share_half_their_lines(spark, monkeypatch):
    rnd = random.Random(4)
    text = lambda k: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(k))
    half = text(60)
    rows = [(i, half + " " + text(60)) for i in range(2000)]
    seen, whole = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, shingle: seen.append(pairs.count()) or whole(pairs, shingle))
    assert N.without_near_copies(spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)).count() == 2000
    assert sum(seen) < 20000


def test_a_large_group_costs_one_comparison_a_member(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(1500):
        w = list(base)
        w[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    seen, whole = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, shingle: seen.append(pairs.count()) or whole(pairs, shingle))
    assert [r["doc_id"] for r in N.without_near_copies(spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)).collect()] == [0]
    assert sum(seen) < 3000


def test_recall_on_the_larger_table(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    groups = brute_by_shingle([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    kept = {r["doc_id"] for r in N.without_near_copies(docs).select("doc_id").collect()}
    first = {i: min(g) for g in groups for i in g}
    assert all(min(g) in kept for g in groups)
    gone = {i for i, f in first.items() if i != f}
    assert not gone >= kept and len(gone - kept) >= 0.9 * len(gone) and set(first) - kept <= gone


def brute_by_shingle(rows):
    """Components over all pairs that share a shingle (others cannot be alike), as sets of ids."""
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets.setdefault(frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), []).append(i)
    keys, by = list(sets), {}
    for k, s in enumerate(keys):
        for x in s:
            by.setdefault(x, []).append(k)
    shared = Counter()
    for members in by.values():
        if 1 < len(members) <= 400:
            shared.update(itertools.combinations(members, 2))
    root = list(range(len(keys)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in shared:
        both = len(keys[a] & keys[b])
        if 5 * both >= 4 * (len(keys[a]) + len(keys[b]) - both):
            root[find(a)] = find(b)
    groups = {}
    for k, s in enumerate(keys):
        groups.setdefault(find(k), set()).update(sets[s])
    return list(groups.values())


@pytest.mark.parametrize("small", [4096, 0])
def test_what_the_rounds_leave_meets_across_roots(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rnd = random.Random(6)
    cutoff = 4
    sets = {sid: (rnd.randrange(3), 100, rnd.choice([0, 0, 0, 1, 2, 3]), rnd.randrange(16), 0) for sid in range(60)}  # label, n, root, w0, w1
    left = spark.createDataFrame([(s, v[0], v[1], v[0] * 10 + v[2]) for s, v in sets.items()], "sid long, label long, n long, root long")
    own = spark.createDataFrame([(s, v[3], v[4]) for s, v in sets.items()], "sid long, w0 long, w1 long")
    seats = {(v[3], v[4]): v[0] for v in sets.values()}
    buckets = spark.createDataFrame([(7, 1, *fp) for fp in seats], "bucket long, tree long, w0 long, w1 long")
    got = [(r.a, r.b) for r in N.candidates(left, own, buckets, cutoff).collect()]
    assert len(got) == len(set(got))
    root = {s: v[0] * 10 + v[2] for s, v in sets.items()}
    near = {(a, b) for a in sets for b in sets if a > b and root[a] != root[b] and (sets[a][3] ^ sets[b][3]).bit_count() <= cutoff}
    assert set(got) == ({(a, b) for a, b in near if sets[a][0] == sets[b][0]} if small else near)


def chained(seed, n):
    """Sets of hashes that are like some of the others: edits upon edits of a few."""
    rng = np.random.default_rng(seed)
    own = [rng.choice(10**9, 100, replace=False).astype(np.uint64) for _ in range(3)]
    while len(own) < n:
        s = own[rng.integers(len(own))].copy()
        s[rng.choice(100, rng.integers(2, 22), replace=False)] = rng.choice(10**9, 1).astype(np.uint64) + np.arange(1, dtype=np.uint64)
        own.append(s)
    return [np.unique(s) for s in own] + [np.empty(0, np.uint64)]


@pytest.mark.parametrize("seed", range(4))
def test_joins_connect_what_all_pairs_connect(seed):
    own = chained(seed, 120)
    words = np.array([N.fingerprint(s) if len(s) else (0, 0) for s in own], np.uint64)
    w0, w1 = (np.ascontiguousarray(words[:, k]) for k in (0, 1))
    root = np.random.default_rng(seed).integers(0, 200 if seed else 20, len(own))
    def components_of(pairs):
        at = np.unique(root, return_inverse=True)[1]
        for i, j in pairs:
            at[at == at[i]] = at[j]
        return {frozenset(np.flatnonzero(at == k)) for k in set(at)}
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if len(own[i]) and N._alike(len(np.intersect1d(own[i], own[j])), len(own[i]), len(own[j]))
             and int(w0[i] ^ w0[j]).bit_count() + int(w1[i] ^ w1[j]).bit_count() <= 28]
    a, b = N.joins(root, w0, w1, own, 28)
    assert set(zip(np.maximum(a, b), np.minimum(a, b))) <= set(pairs) and len(a) < len(own) < len(pairs)
    assert components_of(zip(a, b)) == components_of(pairs)


@pytest.mark.parametrize("tile", [2048, 7])
def test_what_the_rounds_leave_of_a_large_group_lists_no_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    rnd = random.Random(8)
    base, rows = [f"w{rnd.randint(0, 10**6)}" for _ in range(150)], []
    for i in range(60 if tile < 60 else 300):  # edits of one text, most of them too many for a link to another copy
        w = list(base)
        for k in rnd.sample(range(150), rnd.randint(1, 12)):
            w[k] = f"x{i}.{k}"
        rows.append((i, " ".join(w)))
    seen, whole = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, shingle: seen.append(pairs.count()) or whole(pairs, shingle))
    monkeypatch.setattr(N, "ROUNDS", 1)
    monkeypatch.setattr(N, "candidates", lambda *a: pytest.fail("pairs are listed"))
    check(spark, rows, **MEET)
    assert sum(seen) < len(rows)


def test_contracted_edges_are_fewer_and_connect_the_same(spark):
    rnd = random.Random(9)
    edges = [(g * 1000 + a, g * 1000 + rnd.randrange(min(a, 12) + 1)) for g in range(3) for a in range(300) for _ in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = N.contracted(df).collect()
    as_sets = lambda rows: {frozenset([r, *(x.node for x in rows if x.root == r)]) for r in {x.root for x in rows}}
    assert len(few) < 1200 < len({e for e in edges if e[0] != e[1]})
    assert as_sets(N.components(N.contracted(df)).collect()) == as_sets(N.components(df).collect())
