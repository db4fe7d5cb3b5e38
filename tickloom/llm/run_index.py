"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier, through run-length indexes.

1. Candidates. The windows of `DEPTH` bytes of a text are dealt to anchors: the least hash among a window's 32-byte
   strings, leftmost of equals. Equal windows have equal anchors in the same place, so windows can only be equal inside
   a group of equal anchors. Windows that share an anchor follow each other; from the first one's start to the last
   one's end they span a context of 100 to 168 bytes, and every window lies in exactly one context. Anchors only say
   which contexts are looked at together; nothing is removed by a hash.
2. Contexts whose anchor occurs once are done. The bytes of all others are dealt by anchor. The different contexts of a
   few anchors at a time, in order of document and place, make one index (`RunIndex`): the run-length compressed
   Burrows-Wheeler transform, text places sampled at both ends of each run, and the earliest place of what is `DEPTH`
   bytes long, kept where it leaves the diagonal. Every context is streamed through it from its end; its matching
   statistics (length, place) come from steps inside runs and, where a run has another symbol, from the nearer of the
   two neighbouring runs of the wanted one, told by comparing bytes. Where the length is `DEPTH` or more and the
   earliest place lies before the context's own, a window is removed.
3. Anchors that a task meets more than `OFTEN` times among its `FLUSH` contexts, or a shard more than `CROWD` times, are
   crowds: their contexts meet by their bytes, in a partly aggregated minimum over all executors. One that occurs
   earlier loses all its windows; of the first ones the windows meet in the same way, one by one. A task that finds a
   crowd tells the anchor's shard, so that all contexts of a crowd go the same way.
4. What each document loses is gathered by document.

Texts are shuffled by document, in one exchange that both joins use; the contexts of a shard and what is known of them
travel compressed. A task holds one shard of anchors (about 17 bytes for each context) or one shard of contexts.

Document order: doc_id, null last. A document is an id and a text: repeated rows are one document and get one result
each; texts that share an id are ordered by their hash. Null and empty texts, and texts shorter than a window, lose
nothing; an empty table gives no rows; long texts are read piece by piece. Lengths are below 2^32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import landed

DEPTH, GRAM = 100, 32
REACH = DEPTH - GRAM + 1  # 32-byte strings in a window
PIECE = 1 << 20
FLUSH = 1 << 20
SHARD_BYTES = 1 << 25
CROWD, OFTEN = 1 << 14, 64
INDEXED = 1 << 9
CUT = 1 << 25  # bytes of contexts that a task deals at once
NO_ID = 2**63 - 1
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
KEEP = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)  # the first n bytes of a lane


def _lanes(buf: bytes) -> np.ndarray:
    """The 8 bytes at every place, as little-endian integers."""
    return np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def slice_hashes(lanes: np.ndarray, start: np.ndarray, length: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice and its seed."""
    h = _mixed(seed.astype(np.uint64) * M1 + length.astype(np.uint64))
    for lane in range(-(-int(length.max(initial=0)) // 8)):
        rest = np.clip(length - 8 * lane, 0, 8)
        x = lanes[np.where(rest > 0, start + 8 * lane, 0)] & KEEP[rest]
        h = np.where(rest > 0, _mixed((h ^ x) * M1), h)
    return h


def contexts(buf: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor place, first window start and number of windows of each context, for windows that start in [begin, end)
    of each text in `buf`; the bytes of all those windows are in `buf`."""
    lanes = _lanes(buf + b"\0" * 64)
    n = len(buf)
    h = _mixed(lanes[:n] * M1 + _mixed(lanes[8 : n + 8] * M2 + _mixed(lanes[16 : n + 16] * M3 + lanes[24 : n + 24])))
    bits = np.uint64(max(1, n.bit_length()))
    least = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    size = end - begin
    owner = np.repeat(np.arange(len(begin)), size)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
    place = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]) if len(place) else np.empty(0, np.int64)
    return place[head], start[head], np.diff(np.r_[head, len(place)])


class Anchors:
    """Contexts of a stream of texts, gathered in chunks: anchor hash, document, start, windows."""

    def __init__(self) -> None:
        self.docs: list[tuple[int, int]] = []
        self.found: list[tuple[np.ndarray, ...]] = []
        self.count = 0
        self.pending: list[tuple[int, int, bytes, int, int]] = []
        self.size = 0

    def add(self, did: int, th: int, data: bytes) -> None:
        self.docs.append((did, th))
        for at in range(0, len(data) - DEPTH + 1, PIECE):
            windows = min(PIECE, len(data) - DEPTH + 1 - at)
            self.pending.append((len(self.docs) - 1, at, data[at : at + windows + DEPTH - 1], windows, len(data)))
            self.size += windows + DEPTH
            if self.size >= PIECE:
                self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        buf = b"".join(p[2] for p in self.pending)
        length = np.array([len(p[2]) for p in self.pending])
        offset = np.cumsum(length) - length
        windows = np.array([p[3] for p in self.pending])
        place, start, n = contexts(buf, offset, offset + windows)
        piece = np.searchsorted(offset, start, side="right") - 1
        lanes = _lanes(buf + b"\0" * 8)
        anchor = slice_hashes(lanes, place, np.full(len(place), GRAM), np.zeros(len(place)))
        doc, at = (np.array([p[k] for p in self.pending]) for k in (0, 1))
        self.found.append((anchor, doc[piece].astype(np.uint32), (start - offset[piece] + at[piece]).astype(np.uint32), n.astype(np.uint8)))
        self.count += len(n)
        self.pending, self.size = [], 0

    def flush(self, shards: int, spare: int) -> Iterator[dict]:
        """One row per shard: its contexts, and which of its anchors are crowds; contexts of crowds go along with shard `spare`."""
        self.settle()
        if self.found:
            anchor, doc, start, n = (np.concatenate(x) for x in zip(*self.found, strict=True))
            ids, inverse = _unique_rows(np.array(self.docs, np.int64))
            doc = inverse[doc]
            kinds, kind, size = np.unique(anchor, return_inverse=True, return_counts=True)
            often = (size > OFTEN)[kind]
            crowds = kinds[size > OFTEN]
            if len(crowds):
                yield {"shard": spare, "crowd": True, **_blob(ids, doc[often], start[often], n[often], anchor[often])}
            shard, told = ((x % np.uint64(shards)).astype(np.int64) for x in (anchor, crowds))
            shard[often] = shards  # beyond all
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.union1d(np.flatnonzero(np.diff(cuts)), told):
                own = order[cuts[k] : cuts[k + 1]]
                yield {"shard": int(k), "crowd": False, "crowds": crowds[told == k].tobytes(), **_blob(ids, doc[own], start[own], n[own], anchor[own])}
        self.__init__()


def _unique_rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (id, hash) rows in document order, and the place of each row among them."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.r_[True, (ids[order][1:] != ids[order][:-1]).any(axis=1)]
    inverse = np.empty(len(ids), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ids[order][new], inverse


def _blob(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> dict:
    used, new = np.unique(doc, return_inverse=True)
    return {"ids": ids[used].tobytes(), "doc": _squeezed(new.astype(np.uint32)), "start": _squeezed(start), "n": _squeezed(n), "anchor": anchor.tobytes()}


def _squeezed(x: np.ndarray) -> bytes:
    """The numbers compressed, after their count: all first bytes, all second bytes and so on."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _restored(blob: bytes, kind: type[np.generic]) -> np.ndarray:
    count, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(blob[8:], count * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


BLOBS = pa.schema([("shard", pa.int64()), ("crowd", pa.bool_()), *((c, pa.binary()) for c in ("crowds", "ids", "doc", "start", "n", "anchor"))])
# Per document: kind 0 has removed windows (start, count), kind 1 contexts to settle by bytes, kind 2 those of crowds.
MARKS = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("kind", pa.int32()), ("start", pa.binary()), ("n", pa.binary()), ("anchor", pa.binary())])


def _by_document(ids: np.ndarray, doc: np.ndarray, kind: int, start: np.ndarray, n: np.ndarray, anchor: np.ndarray | None = None) -> list[dict]:
    order = np.argsort(doc, kind="stable")
    heads = np.flatnonzero(np.r_[True, doc[order][1:] != doc[order][:-1]])
    out = []
    if not len(order):
        return out
    for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
        own = order[a:b]
        did, th = ids[doc[own[0]]]
        out.append({"did": int(did), "th": int(th), "kind": kind, "start": start[own].tobytes(), "n": n[own].tobytes(),
                    "anchor": None if anchor is None else anchor[own].tobytes()})
    return out


def settle_shard(table: pa.Table) -> pa.Table:
    """All blobs of one shard: contexts of anchors that occur again, told apart by whether the anchor is a crowd."""
    out, parts, crowds, base = [], [], [np.empty(0, np.uint64)], 0
    for row in table.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
        doc, start, n = (_restored(row[c], k) for c, k in (("doc", np.uint32), ("start", np.uint32), ("n", np.uint8)))
        anchor = np.frombuffer(row["anchor"], np.uint64)
        if row["crowd"]:
            out += _by_document(ids, doc, 2, start, n, anchor)
        else:
            crowds.append(np.frombuffer(row["crowds"], np.uint64))
            parts.append((ids, doc.astype(np.int64) + base, start, n, anchor))
            base += len(ids)
    if base:
        ids, doc, start, n, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, inverse = _unique_rows(ids)
        doc = inverse[doc]
        order = np.lexsort((start, doc, anchor))
        doc, start, n, anchor = (x[order] for x in (doc, start, n, anchor))
        once = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]  # repeated rows are one document
        doc, start, n, anchor = (x[once] for x in (doc, start, n, anchor))
        kinds, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
        crowd = ((size > CROWD) | np.isin(kinds, np.concatenate(crowds)))[group]
        for kind, own in ((1, (size[group] > 1) & ~crowd), (2, crowd)):
            out += _by_document(ids, doc[own], kind, start[own], n[own], anchor[own])
    return pa.Table.from_pylist(out, MARKS)


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of several texts, each closed by an end mark of its own.

    Kept are the runs (first row, symbol, and where the first row steps to), the text places sampled at both ends of
    each run, and where the way from a place to the earliest one with the same `depth` bytes changes. The suffix array
    itself, made by prefix doubling, is not kept; the texts are, for comparing bytes.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, depth: int = DEPTH):
        self.data, self.ends, self.depth, n, texts = data, ends, depth, len(data), len(ends)
        owner = np.repeat(np.arange(texts), np.diff(np.r_[0, ends]))
        rest = ends[owner] - np.arange(n)
        self.rest = np.r_[rest, 0]
        symbol = np.r_[data.astype(np.int64) + 1, np.zeros(8, np.int64)]
        key = np.zeros(n, np.int64)  # the first 7 symbols, 0 past the end of a text
        for k in range(7):
            key = key << 9 | np.where(rest > k, symbol[k : n + k], 0)
        rank, suffix = self._ranked(key)
        width, group = 7, None
        most = rest.max(initial=0)
        while width <= most:
            if group is None and 2 * width >= depth >= width:
                group = rank * (n + 1) + np.r_[rank[depth - width :], np.zeros(depth - width, np.int64)][:n]
            # As many ranks as fit in 63 bits. A suffix that has ended is ordered by the place of its text.
            key, bits = rank + texts, (n + texts + 1).bit_length()
            for k in range(1, 63 // bits):
                ended = np.where(rest > (k - 1) * width, owner + 1, 0)
                key = key << bits | np.where(rest > k * width, np.r_[rank[k * width :] + texts, np.zeros(min(k * width, n), np.int64)][:n], ended)
            rank, suffix = self._ranked(key)
            width *= max(2, 63 // bits)
        if group is None and n:
            group = rank if width == depth else self._prefix_ids(data, rest, depth)
        # One end mark per text comes first, in the order of the texts.
        opens = np.zeros(n, bool)
        opens[np.r_[0, ends[:-1]][ends > np.r_[0, ends[:-1]]]] = True
        symbols = np.r_[symbol[ends - 1], np.where(opens[suffix], 0, symbol[suffix - 1])]
        places = np.r_[ends, suffix]
        heads = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        self.heads, self.tails, self.kinds = heads, np.r_[heads[1:], len(symbols)] - 1, symbols[heads]
        self.sampled = places[self.heads], places[self.tails]
        order = np.argsort(self.kinds, kind="stable")
        lengths = self.tails - heads + 1
        self.steps = np.empty(len(heads), np.int64)  # an end mark precedes each text, so what they take up are the end marks' own rows
        self.steps[order] = np.cumsum(lengths[order]) - lengths[order]
        self.by_kind = self.kinds[order] * len(heads) + order
        earliest = np.arange(n)
        long = np.flatnonzero(rest >= depth)
        if len(long):
            _, inverse = np.unique(group[long], return_inverse=True)
            first = np.full(inverse.max() + 1, n)
            np.minimum.at(first, inverse, long)
            earliest[long] = first[inverse]
        back = np.arange(n) - earliest
        self.turns = np.flatnonzero(np.r_[True, back[1:] != back[:-1]][:n])
        self.back = back[self.turns]

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense ranks from 1, and the places in order."""
        order = np.argsort(key)
        value = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[True, value[1:] != value[:-1]][: len(key)])
        return rank, order

    @staticmethod
    def _prefix_ids(data: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
        """Numbers of the different `depth`-byte strings, for depths that the doubling steps over."""
        ids, raw = {}, data.tobytes()
        return np.array([ids.setdefault(raw[i : i + depth], len(ids)) if r >= depth else -1 for i, r in enumerate(rest)])

    def size(self) -> int:
        """Numbers kept, besides the texts."""
        return sum(len(x) for x in (self.heads, self.tails, self.kinds, *self.sampled, self.steps, self.by_kind, self.turns, self.back))

    def earliest(self, place: np.ndarray) -> np.ndarray:
        """The earliest place with the same `depth` bytes as each place."""
        return place - self.back[np.searchsorted(self.turns, place, side="right") - 1]

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from places a and b are equal, `most` at the most."""
        width = int(most.max(initial=0))
        out = np.empty(len(a), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(self.padded(width), width + 1)
        for at in range(0, len(a), 1 << 14):
            own = slice(at, at + (1 << 14))
            differ = view[a[own]] != view[b[own]]
            differ[:, -1] = True
            out[own] = np.minimum(differ.argmax(axis=1), most[own])
        return out

    def padded(self, width: int) -> np.ndarray:
        return np.r_[self.data, np.zeros(width + 1, np.uint8)]

    def match(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of all places of the patterns, one after the other: the length of the longest string from
        there that occurs in the texts, and a place where it does. All patterns are streamed at once, from their ends."""
        pattern = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        stop = np.cumsum([0, *map(len, patterns)])
        length, place = np.zeros(len(pattern), np.int64), np.zeros(len(pattern), np.int64)
        at, begin = stop[1:].copy(), stop[:-1]
        runs = len(self.heads)
        row, start, matched = (np.zeros(len(at), np.int64) for _ in range(3))
        start += self.sampled[0][0] if runs else 0
        live = np.flatnonzero(at > begin)
        while len(live) and runs:
            at[live] -= 1
            wanted, r = pattern[at[live]], row[live]
            run = np.searchsorted(self.heads, r, side="right") - 1
            off = np.flatnonzero(self.kinds[run] != wanted)
            if len(off):
                who, key = live[off], wanted[off] * runs + run[off]
                after = np.searchsorted(self.by_kind, key)
                best = np.full(len(off), -1)
                new_run, new_row, new_start = (np.zeros(len(off), np.int64) for _ in range(3))
                for side, near in ((1, after - 1), (0, after)):  # the last row of the run before, the first of the run after
                    near = np.clip(near, 0, runs - 1)
                    other = self.by_kind[near] % runs
                    has = self.kinds[other] == wanted[off]
                    s = self.sampled[side][other]
                    to = (self.heads, self.tails)[side][other]
                    left = np.where(to < len(self.ends), 0, self.rest[s])  # an end mark's row has nothing left
                    most = np.where(has, np.minimum(matched[who], left), 0)
                    common = np.where(has, self._common(start[who], s, most), -1)
                    better = common > best
                    best[better], new_run[better], new_row[better], new_start[better] = common[better], other[better], to[better], s[better]
                none = best < 0
                run[off], r[off] = np.where(none, run[off], new_run), np.where(none, r[off], new_row)
                start[who] = np.where(none, start[who], new_start)
                matched[who] = np.where(none, -1, best)
                lost = off[none]
            else:
                lost = np.empty(0, np.int64)
            step = np.ones(len(live), bool)
            step[lost] = False  # a symbol that the texts lack: begin anew
            moved = live[step]
            row[moved] = (self.steps[run] + r - self.heads[run])[step]
            start[moved] -= 1
            matched[live] += 1
            length[at[live]], place[at[live]] = matched[live], start[live]
            live = live[at[live] > begin[live]]
        return length, place


CUTS = pa.schema([("shard", pa.int64()), ("anchor", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])


# The contexts of one task that go to one shard.
DEALT = pa.schema([("shard", pa.int64()), ("size", pa.int64()), *((c, pa.binary()) for c in ("anchor", "ids", "doc", "start", "n", "bytes"))])


def dealt(cuts: list[tuple[np.ndarray, ...]], ids: list[tuple[int, int]], texts: list[bytes], shards: int) -> Iterator[dict]:
    """One row per shard of contexts (document among `ids`, start, windows, anchor) with their bytes, `texts`."""
    doc, start, n, anchor = (np.concatenate(x) for x in zip(*cuts, strict=True))
    shard = (anchor % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    heads = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]])
    every = np.array(ids, np.int64)
    for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
        own = order[a:b]
        whole = b"".join([texts[i] for i in own])
        yield {"shard": int(shard[own[0]]), "size": len(whole), "bytes": pa.compress(whole, codec="zstd", asbytes=True),
               **_blob(every, doc[own], start[own].astype(np.uint32), n[own].astype(np.uint8), anchor[own])}


def undealt(table: pa.Table) -> pa.Table:
    """The contexts of `DEALT` rows as `CUTS` rows."""
    out = []
    for row in table.to_pylist():
        doc, start, n = (_restored(row[c], k).astype(np.int64) for c, k in (("doc", np.uint32), ("start", np.uint32), ("n", np.uint8)))
        ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)[doc]
        ends = np.r_[0, np.cumsum(n + DEPTH - 1)].astype(np.int32)
        data = pa.decompress(row["bytes"], row["size"], codec="zstd")
        own = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), data])
        columns = (np.full(len(n), row["shard"]), np.frombuffer(row["anchor"], np.int64), ids[:, 0].copy(), ids[:, 1].copy(), start)
        out.append(pa.Table.from_arrays([*map(pa.array, columns), own], schema=CUTS))
    return pa.concat_tables(out)


def index_shard(table: pa.Table) -> pa.Table:
    """Contexts of one shard of anchors, by bytes: windows that start earlier too, as spans per document.

    Anchors are indexed a few at a time, since equal windows have equal anchors and a small index is a fast one.
    """
    ids = np.column_stack([table.column(c).to_numpy() for c in ("did", "th", "start")])
    anchor, texts = table.column("anchor").to_numpy(), table.column("bytes").to_pylist()
    order = np.lexsort((ids[:, 2], ids[:, 1], ids[:, 0], anchor))
    if len(order):  # a repeated row is one document and brings each of its contexts once
        at = np.column_stack([anchor, ids])[order]
        order = order[np.r_[True, (at[1:] != at[:-1]).any(axis=1)]]
    cuts, last = [0], len(order)
    heads = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
    while last - cuts[-1] > INDEXED and (after := heads[heads >= cuts[-1] + INDEXED]).size:
        cuts.append(int(after[0]))
    rows, place, many = [], [], []
    for a, b in zip(cuts, [*cuts[1:], last], strict=True):
        own = order[a:b]
        own = own[np.lexsort((ids[own, 2], ids[own, 1], ids[own, 0]))]
        first: dict[bytes, int] = {}  # the different contexts, in order of document and place
        number = np.array([first.setdefault(texts[i], len(first)) for i in own])
        different = list(first)
        size = np.array([len(t) for t in different])
        ends = np.cumsum(size)
        index = RunIndex(np.frombuffer(b"".join(different), np.uint8), ends)
        length, found = index.match(different)
        seen = np.zeros(len(length), bool)
        long = np.flatnonzero(length >= DEPTH)
        seen[long] = index.earliest(found[long]) < long
        begin = ends - size
        again = np.r_[False, number[1:] <= np.maximum.accumulate(number)[:-1]] if len(number) else np.empty(0, bool)
        for i, no, repeated in zip(own, number, again, strict=True):  # a context that occurs before is there with all its windows
            windows = int(size[no]) - DEPTH + 1
            gone = np.ones(windows, bool) if repeated else seen[begin[no] : begin[no] + windows]
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False]))  # where runs of removed windows begin and end
            rows.append(np.full(len(turns) // 2, i))
            place.append(ids[i, 2] + turns[::2])
            many.append(turns[1::2] - turns[::2])
    docs, doc = _unique_rows(ids[:, :2])
    rows, start, n = (np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, place, many))
    return pa.Table.from_pylist(_by_document(docs, doc[rows], 0, start.astype(np.uint32), n.astype(np.uint8)), MARKS)


def _spans(pairs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [a, b) of removed bytes from windows (start, count)."""
    start = np.concatenate([np.frombuffer(s, np.uint32) for s, _ in pairs]).astype(np.int64)
    end = start + np.concatenate([np.frombuffer(n, np.uint8) for _, n in pairs]).astype(np.int64) + DEPTH - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.r_[True, start[1:] > end[:-1]]
    return start[head], end[np.r_[head[1:], True]]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with their place in the document order (did, th) and their bytes."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # Hashes are below 0 for a document with an id, so that one without comes after it whatever the id.
    th = F.when(F.col(doc_id).isNull(), F.xxhash64(data).bitwiseAND(F.lit(NO_ID))).otherwise(F.xxhash64(data).bitwiseOR(F.lit(-NO_ID - 1)))
    return docs.withColumns({"did": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "th": th, "data": data})


def removals(texts: DataFrame) -> DataFrame:
    """(did, th, marks): the windows that each of the `keyed` texts (did, th, data) loses; no row if none."""
    size = texts.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, did = Anchors(), 0
        for batch in batches:
            for did, th, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                gathered.add(did, th, data.as_py())
                if gathered.count >= FLUSH:
                    yield from (pa.RecordBatch.from_pylist([row], BLOBS) for row in gathered.flush(shards, did % shards))
        yield from (pa.RecordBatch.from_pylist([row], BLOBS) for row in gathered.flush(shards, did % shards))

    found = texts.mapInArrow(anchors, _ddl(BLOBS)).groupBy("shard").applyInArrow(settle_shard, _ddl(MARKS))
    found = landed(found, "contexts")
    count = {r["kind"]: r["n"] for r in found.where("kind > 0").groupBy("kind").agg(F.sum(F.octet_length("n")).alias("n")).collect()}
    marks = texts.sparkSession.createDataFrame([], "did long, th long, start binary, n binary")
    if 1 in count:
        marks = marks.union(_by_index(texts, found.where("kind = 1"), max(1, -(-count[1] // CROWD))))
    if 2 in count:
        marks = marks.union(_by_bytes(texts, found.where("kind = 2")))
    return marks.groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("marks"))


def _asked(texts: DataFrame, found: DataFrame) -> DataFrame:
    asked = found.groupBy("did", "th").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("asked"))
    return texts.join(asked, ["did", "th"]).select("did", "th", "data", "asked")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(did, th, bytes, starts, windows, anchors) of each document's contexts in question."""
    for batch in batches:
        for row in range(len(batch)):
            did, th, data, asked = (batch.column(k)[row].as_py() for k in range(4))
            start, n, anchor = (np.concatenate([np.frombuffer(x[c], k) for x in asked]) for c, k in (("start", np.uint32), ("n", np.uint8), ("anchor", np.uint64)))
            yield did, th, data, start.astype(np.int64), n.astype(np.int64), anchor


def _by_index(texts: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, ids, held, size = [], [], [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                yield from (pa.RecordBatch.from_pylist([row], DEALT) for row in dealt(cuts, ids, held, shards))

        for did, th, data, start, n, anchor in _cut(batches):
            for at in range(0, len(n), 1 << 14):
                own = slice(at, at + (1 << 14))
                cuts.append((np.full(len(n[own]), len(ids)), start[own], n[own], anchor[own]))
                held += [data[a : a + m + DEPTH - 1] for a, m in zip(start[own].tolist(), n[own].tolist(), strict=True)]
                ids.append((did, th))
                size += int((n[own] + DEPTH - 1).sum())
                if size >= CUT:
                    yield from flushed()
                    cuts, ids, held, size = [], [], [], 0
        yield from flushed()

    cuts = _asked(texts, found).mapInArrow(cut, _ddl(DEALT))
    return cuts.groupBy("shard").applyInArrow(lambda rows: index_shard(undealt(rows)), _ddl(MARKS)).select("did", "th", "start", "n")


def _by_bytes(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Windows of crowds: all but the first of those with equal bytes. Of contexts with equal bytes all but the first
    lose every window, and the earliest place of a window is in the first ones."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for did, th, data, start, n, _ in _cut(batches):
            for at in range(0, len(n), 1 << 14):
                own = slice(at, at + (1 << 14))
                bytes_of = pa.array([data[a : a + m + DEPTH - 1] for a, m in zip(start[own].tolist(), n[own].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([bytes_of, *(pa.array(x) for x in (np.full(len(bytes_of), did), np.full(len(bytes_of), th), start[own]))], names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                data, first = part.column(0).to_pylist(), part.column(1)
                n = np.array([len(d) - DEPTH + 1 for d in data])
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                did, th, place = (np.repeat(first.field(c).to_numpy(), n) for c in ("did", "th", "place"))
                yield pa.RecordBatch.from_arrays([pa.array([d[k : k + DEPTH] for d, m in zip(data, n, strict=True) for k in range(m)], pa.binary()), *map(pa.array, (did, th, place + step))], names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, th, marks in zip(*batch.columns, strict=True):
                start, n = (marks.values.field(c).to_numpy() for c in ("place", "n"))
                rows.append({"did": did.as_py(), "th": th.as_py(), "kind": 0, "start": start.astype(np.uint32).tobytes(), "n": n.astype(np.uint8).tobytes(), "anchor": None})
            yield pa.RecordBatch.from_pylist(rows, MARKS)

    names = ["bytes", "did", "th", "place"]
    kinds = "bytes binary, did long, th long, place long"
    at = F.struct("did", "th", "place")

    def firsts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bytes").agg(F.min(at).alias("first"), F.max(at).alias("last"))

    def later(rows: DataFrame, first: DataFrame) -> DataFrame:
        own = rows.join(first.where("first < last").select("bytes", "first"), "bytes").where(at > F.col("first"))
        return own.select("did", "th", "place", (F.octet_length("bytes") - (DEPTH - 1)).alias("n"))

    rows = _asked(texts, found).mapInArrow(cut, kinds)
    first = firsts(rows)  # not landed: a job of its own would shuffle the texts once more
    single = first.mapInArrow(windows, kinds)
    gone = later(rows, first).union(later(single, firsts(single)))
    gone = gone.groupBy("did", "th").agg(F.collect_list(F.struct("place", "n")).alias("marks"))
    return gone.mapInArrow(packed, _ddl(MARKS)).select("did", "th", "start", "n")


def _loss(marks: list | None) -> tuple[np.ndarray, np.ndarray]:
    return _spans([(m["start"], m["n"]) for m in marks]) if marks else (np.empty(0, np.int64), np.empty(0, np.int64))


def kept_bytes(data: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip(np.r_[0, end], np.r_[start, len(data)], strict=True))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, data, marks in zip(*batch.columns, strict=True):
                raw, (start, end) = data.as_py(), _loss(marks.as_py())
                rows.append((did.as_py(), len(raw), int((end - start).sum()), len(start), hashlib.sha256(kept_bytes(raw, start, end)).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names)

    texts = keyed(docs, doc_id, text).select("did", "th", "data")
    known = F.when(F.col("th") < 0, F.col("did")).alias("did")
    both = texts.join(removals(texts), ["did", "th"], "left").select(known, "data", "marks")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the removed bytes; a character that is removed in part stays whole. Null texts stay null."""
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, marks in zip(batch.column(at), batch.column(len(columns)), strict=True):
                if marks.as_py() is None:
                    texts.append(raw.as_py())
                    continue
                data = raw.as_py().encode()
                lead = np.r_[(np.frombuffer(data, np.uint8) & 0xC0) != 0x80, True]
                first = np.flatnonzero(lead)  # where characters begin, and the end
                start, end = _loss(marks.as_py())
                start, end = first[np.searchsorted(first, start)], first[np.searchsorted(first, end, side="right") - 1]
                texts.append(kept_bytes(data, start, end).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(columns)]], columns)

    own = keyed(docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_id", "_text")
    spare = "marks" + "_" * max(map(len, columns))  # no column has this name
    both = own.select("row", "did", "th").join(removals(own.select("did", "th", "data")), ["did", "th"], "left").select("row.*", F.col("marks").alias(spare))
    return both.mapInArrow(run, docs.schema)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)
