import hashlib
import random

import numpy as np
import pytest
from conftest import SF

from tickloom.llm import run_index as R
from tickloom.llm.common import table

DOCS = "doc_id long, text string, did string, marks int"


def brute(rows, depth=100):
    """(doc_id, bytes, removed, spans, digest) by one dictionary of all windows, in document order."""
    seen, out = set(), []
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    result = {}
    for none, i, t in docs:
        data = t.encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - depth + 1):
            w = data[k : k + depth]
            if w in seen:
                gone[k : k + depth] = True
            seen.add(w)
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        result[none, i, t] = (None if none else i, len(data), int(gone.sum()), spans,
                              hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    for i, t in rows:
        out.append(result[i is None, i or 0, t or ""])
    return sorted(out, key=str)


def check(spark, rows):
    got = R.digests(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def material(seed=0, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(40) for _ in range(3)]
    rows = []
    for i in range(n):
        t = text(rnd.randint(0, 120))
        if i % 3 == 0:
            t = text(10) + rnd.choice(passages) + text(10)
        if i % 7 == 0 and rows:
            w = rnd.choice(rows)[1].split()
            if w:
                w[rnd.randrange(len(w))] = word()
            t = " ".join(w)
        if i % 10 == 0 and rows:
            t = rnd.choice(rows)[1]
        if i % 11 == 0:
            t = t + t[::-1] + t
        rows.append((i * 7 % n, t))
    return rows


def test_all_documents_against_every_window(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()])


@pytest.mark.parametrize("crowd", [1 << 14, 2])
def test_copies_edits_and_shared_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(R, "CROWD", crowd)  # 2: most anchors are crowds, and the others many shards
    monkeypatch.setattr(R, "SHARD_BYTES", 4000)
    check(spark, material())


def test_small_pieces_and_flushes(spark, monkeypatch):
    rows = material(3, 40)
    whole = brute(rows)
    monkeypatch.setattr(R, "PIECE", 150)
    monkeypatch.setattr(R, "FLUSH", 50)
    monkeypatch.setattr(R, "INDEXED", 10)
    texts = sorted({(i, t) for i, t in rows})
    gathered, tables = R.Anchors(), []
    for i, t in texts:
        gathered.add(i, 0, t.encode())
        if gathered.count >= R.FLUSH:
            tables += list(gathered.flush(1, 0))
    tables += list(gathered.flush(1, 0))
    marks = R.settle_shard(R.pa.Table.from_pylist(tables, R.BLOBS)).to_pylist()
    by = {}
    data = {i: t.encode() for i, t in texts}
    cuts = []
    for m in marks:
        if m["kind"]:
            for a, n, h in zip(np.frombuffer(m["start"], np.uint32), np.frombuffer(m["n"], np.uint8), np.frombuffer(m["anchor"], np.int64)):
                cuts.append({"shard": 0, "anchor": int(h), "did": m["did"], "th": 0, "start": int(a), "bytes": data[m["did"]][a : a + int(n) + 99]})
    for m in R.index_shard(R.pa.Table.from_pylist(cuts, R.CUTS)).to_pylist():
        by.setdefault(m["did"], []).append(m)
    got = []
    for i, t in texts:
        start, end = R._loss(by.get(i))
        got.append((i, len(data[i]), int((end - start).sum()), len(start), hashlib.sha256(R.kept_bytes(data[i], start, end)).hexdigest()))
    assert sorted(got, key=str) == sorted(set(whole), key=str)


def test_odd_rows(spark):
    line = "0123456789" * 12
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, "a" * 99), (5, "a" * 100), (6, "ab" * 200), (7, line), (7, line), (7, line + "x"),
            (None, line), (None, None), (-1, line[:100]), (8, "\0" * 150 + "é" * 80), (9, "é" * 80 + "\0" * 130), (10, "b" + line[1:])]
    check(spark, rows)
    assert R.digests(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("crowd", [1 << 14, 1])
def test_repeated_rows_are_one_document(spark, monkeypatch, crowd):
    monkeypatch.setattr(R, "CROWD", crowd)
    a, b, c, d, p = ("".join(random.Random(k).choices("abcdefgh ", k=300)) for k in range(5))
    check(spark, [(1, a + p + b), (1, a + p + b), (2, c + p + d), (None, d + c), (None, d + c), (None, a + c)])


def test_text_is_cut_at_characters(spark):
    shared = "".join(random.Random(9).choices("éüñ", k=60))
    half = "ã" + shared[1:]  # shares the first byte of its first character only
    assert half.encode()[0] == shared.encode()[0]
    rows = [(1, "x" + shared + "y"), (2, "zz" + shared), (3, None), (4, "short"), (5, "q" + half)]
    out = {r["doc_id"]: r for r in R.deduplicated(spark.createDataFrame([(i, t, "keep", 5) for i, t in rows], DOCS)).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "zz" and out[3]["text"] is None and out[4]["text"] == "short" and out[5]["text"] == "qã"
    assert all(r["did"] == "keep" and r["marks"] == 5 for r in out.values())


def texts_of(seed):
    rnd = random.Random(seed)
    base = bytes(rnd.choices(b"ab\x00\xff", k=60))
    return [base[rnd.randint(0, 20) :] + bytes(rnd.choices(b"ab", k=rnd.randint(0, 30))) for _ in range(30)]


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    texts, rnd = texts_of(seed), random.Random(seed)
    whole, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    index = R.RunIndex(np.frombuffer(whole, np.uint8), ends, depth=12)
    patterns = texts + [bytes(rnd.choices(b"ab\x00\xffz", k=k)) for k in (0, 1, 5, 40, 90)] + [b"z" * 7, texts[3][10:40] + b"z" + texts[5][:25]]
    length, place = index.match(patterns)
    at = 0
    for p in patterns:
        for k in range(len(p)):
            longest = max(m for m in range(len(p) - k + 1) if any(p[k : k + m] in t for t in texts))
            assert length[at] == longest
            if longest:
                assert whole[place[at] : place[at] + longest] == p[k : k + longest]
            at += 1
    for p in range(len(whole)):
        owner = np.searchsorted(ends, p, side="right")
        window = whole[p : p + 12]
        if p + 12 <= ends[owner]:
            firsts = [q for q in range(p + 1) if whole[q : q + 12] == window and q + 12 <= ends[np.searchsorted(ends, q, side="right")]]
            assert index.earliest(np.array([p]))[0] == firsts[0]
    assert len(index.heads) < ends[-1] / 2


def test_the_index_grows_with_runs_and_not_with_bytes():
    rnd = random.Random(1)
    base = bytes(rnd.choices(b"abcdefgh", k=600))
    def built(copies):
        texts = []
        for _ in range(copies):
            t = bytearray(base)
            t[rnd.randrange(600)] = rnd.choice(b"abcdefgh")
            texts.append(bytes(t))
        return R.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    one, many = built(1), built(100)
    assert many.size() < 8 * one.size() and many.size() < 0.5 * len(many.data)


def test_crowds_of_one_task_and_of_one_shard(spark, monkeypatch):
    rows = material(5) + [(100 + i, f"{i} " * (i % 4) + "a common line of some length that stands in a great many documents, " * 3 + f"x{i}") for i in range(60)]
    monkeypatch.setattr(R, "OFTEN", 3)
    check(spark, rows)
    monkeypatch.setattr(R, "OFTEN", 10**6)
    monkeypatch.setattr(R, "CROWD", 20)
    check(spark, rows)


def test_an_id_like_the_stand_in_for_none(spark):
    a, b = ("".join(random.Random(k).choices("abcdefgh ", k=300)) for k in range(2))
    got = R.digests(spark.createDataFrame([(i, t, "x", 1) for i, t in [(2**63 - 1, a), (None, a), (None, b), (2**63 - 1, b)]], DOCS)).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in got) == [(False, 0), (False, 0), (True, 300), (True, 300)]


def test_crowds_make_a_row_for_each_document_at_most(spark, monkeypatch):
    words = random.Random(6)
    line = "".join(words.choices("abcdefgh ", k=1000))
    rows = [(i, "".join(words.choices("abcdefgh ", k=150)) + line + "".join(words.choices("abcdefgh ", k=150))) for i in range(640)]  # over 64 in each task
    rows += [(640 + i, line[: 995 - i % 3] + "xyz" * (i % 4)) for i in range(120)]
    told, whole = [], R._by_bytes

    def by_bytes(texts, found):
        marks = whole(texts, found)
        told.append((marks.count(), sum(len(r["n"]) for r in found.collect())))
        return marks
    monkeypatch.setattr(R, "_by_bytes", by_bytes)
    check(spark, rows)
    made, contexts = told[0]
    assert made <= len(rows) < contexts / 3


def test_dealt_contexts_come_back_and_are_small():
    rnd = random.Random(7)
    data = [" ".join(rnd.choice(["some", "common", "words", "of", "any", "text"]) for _ in range(400)).encode() for _ in range(20)]
    cuts, held = [], []
    for k, d in enumerate(data):
        start = np.arange(0, len(d) - 168, 30)
        n = np.array([rnd.randint(1, 69) for _ in start])
        cuts.append((np.full(len(n), k), start, n, np.array([rnd.getrandbits(64) for _ in n], np.uint64)))
        held += [d[a : a + m + 99] for a, m in zip(start, n)]
    ids = [(k * 5, -k) for k in range(20)]
    sent = R.pa.Table.from_pylist(list(R.dealt(cuts, ids, held, 3)), R.DEALT)
    got = R.undealt(sent).to_pylist()
    doc, start, _, anchor = (np.concatenate(x) for x in zip(*cuts))
    want = [{"shard": int(h % np.uint64(3)), "anchor": int(h.view(np.int64)), "did": ids[k][0], "th": ids[k][1], "start": int(a), "bytes": x}
            for k, a, h, x in zip(doc, start, anchor, held)]
    key = lambda r: (r["did"], r["start"])
    assert sorted(got, key=key) == sorted(want, key=key) and sent.num_rows == 3
    assert sent.nbytes < sum(map(len, held)) / 2


def test_runs_of_removed_windows_are_one_mark():
    texts = [bytes(random.Random(3).choices(b"abcd", k=168))] * 2 + [b"z" * 20]
    rows = [{"shard": 0, "anchor": 1, "did": i, "th": 0, "start": 7, "bytes": t} for i, t in enumerate(texts[:2])]
    out = R.index_shard(R.pa.Table.from_pylist(rows, R.CUTS)).to_pylist()
    assert [(m["did"], len(m["n"])) for m in out] == [(1, 1)] and [x.tolist() for x in R._loss(out)] == [[7], [175]]
