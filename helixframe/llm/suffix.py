"""Removal of repeated passages by a multi-document suffix order built column by column.

A passage is a string of ``width`` bytes that also starts in a document with a
smaller id. Documents are cut into fragments, so that every such string lies
whole in one fragment and equal strings lie in fragments with the same anchor;
fragments are dealt out by anchor, and only anchors seen in two documents go
further. For each collection of fragments the Burrows-Wheeler transform and
the common prefixes are built by inserting one symbol per fragment each round;
runs of the suffix order that share ``width`` bytes are the repeated strings.

Packs of documents stay where they were written; what travels are digests of
anchors, then the fragments of repeated anchors once per pack, and back come
the least owners of their strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from .bytefeat import U64, mix64, span_hashes, text_buffers
from .util import Scratch

#: Bytes of a repeated string; bytes of an anchor. An anchor lies in each window of WIDTH bytes.
WIDTH, GRAM = 50, 16

#: Text bytes of a pack, and about how many text bytes answer to one bucket of anchors.
PACK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20

#: Bytes of an anchor's digest that are compared within a bucket: two anchors taken for one cost work, never a wrong result.
ANCHOR_BYTES = 5

#: Fragments whose suffix order is built together (more if they share an anchor).
COLLECTION = 16_384

#: Windows whose anchors are found together, so that their hashes stay in a core's cache.
STRETCH = 16_384

#: Packs, or blobs of a bucket, in an Arrow batch.
PACKS_AT_ONCE = 2

#: Stands for a null id: larger than any.
NO_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------- suffix order


def suffix_order(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of a collection of strings without byte 255.

    Round r inserts, for every string longer than r, the symbol before its
    suffix of length r. The transform is kept with an entry per suffix in
    order, symbols raised by one and 0 where a string begins; the place of a
    longer suffix follows from the rank of its first symbol at the place of the
    shorter one. Common prefixes change only at new suffixes and those after
    them, where they are one more than the least between the two entries that
    gave rise to the neighbours.
    """
    n = len(lens)
    end = np.cumsum(lens)
    bwt, lcp = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    place, alive = np.arange(n), np.arange(n)
    for r in range(int(lens.max(initial=0))):
        on = lens[alive] > r
        alive, place = alive[on], place[on]
        bwt[place] = data[end[alive] - 1 - r] + np.uint8(1)
        fresh = np.zeros(len(bwt), bool)
        fresh[place] = True
        order = np.argsort(bwt, kind="stable")
        order = order[len(bwt) - np.count_nonzero(bwt) :]  # symbols only
        born = fresh[order]
        # entries whose predecessor in the order is new, or that are new themselves
        k = np.flatnonzero(born[1:] | born[:-1]) + 1
        k = k[bwt[order[k]] == bwt[order[k - 1]]]
        a, b = order[k - 1] + 1, order[k] + 1
        by = np.argsort(a, kind="stable")
        least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), np.stack([a[by], b[by]], 1).ravel())[::2]
        new_bwt, new_lcp = np.zeros(n + len(order), np.uint8), np.zeros(n + len(order), np.uint8)
        new_bwt[:n] = bwt[:n]
        kept = n + np.flatnonzero(~born)
        new_bwt[kept], new_lcp[kept] = bwt[n:], lcp[n:]
        symbols = np.bincount(bwt, minlength=256)[1:]
        new_lcp[(n + np.cumsum(symbols) - symbols)[symbols > 0]] = 0  # the first suffix of each symbol
        new_lcp[n + k[by]] = least + np.uint8(1)
        # where each string's longer suffix went
        came = np.flatnonzero(born)
        by_place = np.argsort(place)
        who = by_place[np.searchsorted(place[by_place], order[came])]
        place[who] = n + came
        bwt, lcp = new_bwt, new_lcp
    return bwt, lcp


def least_owners(data: np.ndarray, lens: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """String by string, the least owner of every ``width``-byte string that starts in it (in order of place)."""
    bwt, lcp = suffix_order(data, lens)
    order = np.argsort(bwt, kind="stable")
    zeros = len(bwt) - np.count_nonzero(bwt)
    spot = np.zeros(len(bwt), np.int64)
    spot[order[zeros:]] = np.arange(len(lens), len(lens) + len(bwt) - zeros)
    group = np.cumsum(lcp < width) - 1
    at, alive = np.arange(len(lens)), np.arange(len(lens))
    found = []
    for r in range(1, int(lens.max(initial=0)) + 1):  # walk from the end of each string to its start
        on = lens[alive] >= r
        alive, at = alive[on], spot[at[on]]
        if r >= width:
            found.append((alive, group[at]))
    best = np.full(group[-1] + 1 if len(group) else 0, NO_ID)
    for who, g in found:
        np.minimum.at(best, g, owner[who])
    count = np.maximum(lens - width + 1, 0)
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for r, (who, g) in enumerate(found):  # suffix of length width + r starts at lens - width - r
        out[first[who] + lens[who] - width - r] = best[g]
    return out


# ---------------------------------------------------------------- fragments


def _gram_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of GRAM bytes from their first and last eight as integers."""
    with np.errstate(over="ignore"):
        gram = first * U64(0x9E3779B97F4A7C15)
        gram += last * U64(0xC2B2AE3D27D4EB4F)
        gram ^= gram >> U64(29)
        gram *= U64(0xBF58476D1CE4E5B9)
        gram ^= gram >> U64(32)
    return gram


def anchor_digests(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Digests of the anchors at some places, as ``fragments`` gives them."""
    half = np.arange(8)
    first, last = (np.ascontiguousarray(data[place[:, None] + (half + d)]).view("<u8")[:, 0] for d in (0, GRAM - 8))
    return mix64(_gram_hash(first, last))


def fragments(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest of the anchor, row, start, windows, offset of the anchor from the start) of every fragment.

    A window's anchor is its GRAM-byte string of least hash (the leftmost of
    equal ones); a fragment is a run of windows of one text with one anchor,
    ``start`` the place of the first in ``data``.
    """
    none = np.zeros(0, np.int64)
    n, span = len(data), width - GRAM + 1
    if n < width:
        return none.view(U64), none, none, none, none
    eight = np.ndarray((n - 7,), "<u8", data.tobytes(), 0, (1,))  # the eight bytes from each place on
    low = U64((1 << 36) - 1)  # places; the rest of the hash decides first
    # windows that lie in one text; those of two texts are never neighbours
    inside = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= width)
    inside[offsets[long]] += 1
    inside[offsets[long + 1] - width + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8).view(bool)
    place = np.arange(STRETCH + span, dtype=U64)
    starts, digests, insets = [], [], []
    last = -1  # anchor of the window before, if there is one
    for at in range(0, n - width + 1, STRETCH):
        m = min(STRETCH, n - width + 1 - at)
        ok = inside[at : at + m]
        if not ok.any():
            last = -1
            continue
        grams = m + span - 1
        gram = _gram_hash(eight[at : at + grams], eight[at + GRAM - 8 : at + GRAM - 8 + grams])
        best, size = (gram & ~low) | place[:grams], 1
        while size * 2 <= span:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        best = np.minimum(best[:m], best[span - size : span - size + m])
        p = (best & low).astype(np.int64)
        begin = ok.copy()
        begin[1:] &= (p[1:] != p[:-1]) | ~ok[:-1]
        begin[0] &= last != p[0] + at
        f = np.flatnonzero(begin)
        starts.append(f + at)
        digests.append(mix64(gram[p[f]]))
        insets.append(p[f] - f)
        last = int(p[-1]) + at if ok[-1] else -1
    if not starts:
        return none.view(U64), none, none, none, none
    start = np.concatenate(starts)
    row = np.searchsorted(offsets, start, side="right") - 1
    windows = np.minimum(np.append(start[1:], n), offsets[row + 1] - width + 1) - start
    return np.concatenate(digests), row, start, windows, np.concatenate(insets)


def _squeeze(*arrays: np.ndarray) -> bytes:
    body = b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(body)


def _expand(blob: bytes) -> memoryview:
    return memoryview(zstandard.ZstdDecompressor().decompress(blob))


class Pack:
    """Some rows, their texts and ids, and the fragments of those texts."""

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str, width: int) -> None:
        self.batch, self.width = batch, width
        self.data, self.offsets, _ = text_buffers(batch.column(batch.schema.get_field_index(text_col)))
        ids = batch.column(batch.schema.get_field_index(id_col))
        self.ids = np.array([NO_ID if x is None else x for x in ids.to_pylist()], np.int64)
        self.anchor, self.row, self.start, self.windows, self.inset = fragments(self.data, self.offsets, width)

    def anchors(self, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, sorted distinct anchors, which of them occur under two ids here)."""
        u, inv = np.unique(self.anchor, return_inverse=True)
        lo, hi = np.full(len(u), NO_ID), np.full(len(u), np.iinfo(np.int64).min)
        np.minimum.at(lo, inv, self.ids[self.row])
        np.maximum.at(hi, inv, self.ids[self.row])
        where = (u % U64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        edge = np.searchsorted(where[order], np.arange(buckets + 1))
        return [(k, u[order[a:b]], (lo != hi)[order[a:b]]) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]

    def repeated(self, buckets: int, bits: dict[int, np.ndarray]) -> dict[int, tuple]:
        """bucket -> (fragments here, for each its number among the distinct ones, those: start, windows, least id, inset of the anchor)."""
        out = {}
        parts = self.anchors(buckets)
        keep = np.concatenate([u[bits[k].astype(bool)[: len(u)]] for k, u, _ in parts if k in bits] or [np.zeros(0, U64)])
        keep.sort()
        at = np.searchsorted(keep, self.anchor)
        hit = np.flatnonzero((at < len(keep)) & (keep[np.minimum(at, max(len(keep) - 1, 0))] == self.anchor)) if len(keep) else np.zeros(0, np.int64)
        if not len(hit):
            return out
        text = _span_texts(self.data, self.start[hit], self.windows[hit] + self.width - 1)
        where = (self.anchor[hit] % U64(buckets)).astype(np.int64)
        order = np.lexsort((text, self.anchor[hit], where))
        hit, text, where = hit[order], text[order], where[order]
        new = np.ones(len(hit), bool)
        new[1:] = (text[1:] != text[:-1]) | (self.anchor[hit[1:]] != self.anchor[hit[:-1]])
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[self.row[hit]], first)
        keys = np.unique(where)
        of_hit = np.append(np.searchsorted(where, keys), len(where))
        of_first = np.append(np.searchsorted(where[first], keys), len(first))
        for n, k in enumerate(keys):
            mine, those = slice(of_hit[n], of_hit[n + 1]), slice(of_first[n], of_first[n + 1])
            f = hit[first[those]]
            out[int(k)] = (hit[mine], number[mine] - of_first[n], self.start[f], self.windows[f], least[those], self.inset[f])
        return out

    def blob(self, part: tuple) -> bytes:
        """The distinct fragments of a bucket, to be sent."""
        _, _, start, windows, least, inset = part
        length = windows + self.width - 1
        take = _ranges(start, length)
        return _squeeze(np.array([len(start)], np.int64), least, length.astype(np.uint8), inset.astype(np.uint8), self.data[take])


def _read_blob(blob: bytes) -> tuple[np.ndarray, ...]:
    v = _expand(blob)
    n = int(np.frombuffer(v[:8], np.int64)[0])
    at = 8 + 8 * n
    lengths, insets = (np.frombuffer(v[at + i * n : at + (i + 1) * n], np.uint8).astype(np.int64) for i in range(2))
    data = np.frombuffer(v[at + 2 * n :], np.uint8)
    anchors = anchor_digests(data, np.cumsum(lengths) - lengths + insets)
    return anchors, np.frombuffer(v[8:at], np.int64), lengths, insets, data


def _span_texts(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of many short spans, a bounded number at a time."""
    out = np.zeros(len(start), U64)
    for i in range(0, len(start), COLLECTION):
        n = length[i : i + COLLECTION]
        at = np.cumsum(n) - n
        out[i : i + COLLECTION] = span_hashes(data[_ranges(start[i : i + COLLECTION], n)], at, at + n)
    return out


def _distinct(key: np.ndarray, text: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each item among the distinct (key, text), an item of each, its least owner), in order of key."""
    order = np.lexsort((text, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[first], np.minimum.reduceat(owner[order], first) if len(first) else owner[:0]


def _group_sizes(key: np.ndarray) -> np.ndarray:
    """For each of some sorted keys, how often it occurs."""
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    per = np.diff(np.append(head, len(key)))
    return np.repeat(per, per)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _solve(data: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least owner of every window, first place of each string's windows in it) among strings of one key.

    Equal strings are one; a key with one string needs no comparison; the
    others go through the suffix order, in collections of whole keys.
    """
    number, rep, best = _distinct(key, _span_texts(data, start, length), owner)
    r_start, r_len, r_key = start[rep], length[rep], key[rep]
    windows = r_len - width + 1
    first = np.cumsum(windows) - windows
    result = np.repeat(best, windows)
    todo = np.flatnonzero(_group_sizes(r_key) > 1)
    at = 0
    while at < len(todo):
        to = min(at + COLLECTION, len(todo))
        while to < len(todo) and r_key[todo[to]] == r_key[todo[to - 1]]:
            to += 1
        part = todo[at:to]
        result[_ranges(first[part], windows[part])] = least_owners(data[_ranges(r_start[part], r_len[part])], r_len[part], best[part], width)
        at = to
    return result, first[number]


def owners_of_bucket(blobs: list[bytes], width: int) -> list[bytes]:
    """For each pack's blob: the least owner of every window of its fragments, run by run.

    Equal fragments of several packs are one string owned by the least id. An
    anchor with several strings is divided further: windows that reach far to
    its right by the bytes that follow it, the others by the bytes before it,
    so that strings that share no more than a common phrase part at once.
    """
    read = [_read_blob(b) for b in blobs]
    count = np.array([len(r[0]) for r in read])
    anchor, least, length, inset = (np.concatenate([r[i] for r in read]) for i in range(4))
    data = np.concatenate([r[4] for r in read])
    del read
    start = np.cumsum(length) - length
    string, rep, owner = _distinct(anchor, _span_texts(data, start, length), least)
    s_anchor, s_start, s_len, s_inset = anchor[rep], start[rep], length[rep], inset[rep]
    windows = s_len - width + 1
    w_first = np.cumsum(windows) - windows
    result = np.repeat(owner, windows)
    many = np.flatnonzero(_group_sizes(s_anchor) > 1)
    if len(many):
        side = (width - GRAM) // 2  # bytes of context that decide
        p = s_start[many] + s_inset[many]
        n_left = np.clip(s_inset[many] - side, 0, windows[many])  # windows in which more than ``side`` bytes come before the anchor
        n_right = windows[many] - n_left
        parts = []
        for n, at, c in ((n_left, np.zeros_like(n_left), p - side), (n_right, n_left, p + GRAM)):
            use = np.flatnonzero(n > 0)
            with np.errstate(over="ignore"):
                key = mix64(s_anchor[many[use]] + _span_texts(data, c[use], np.full(len(use), side)) * U64(2 * len(parts) + 3))
            parts.append((key, s_start[many[use]] + at[use], n[use] + width - 1, owner[many[use]], w_first[many[use]] + at[use], n[use]))
        key, at, size, own, place, n = (np.concatenate([x[i] for x in parts]) for i in range(6))
        got, first = _solve(data, key, at, size, own, width)
        result[_ranges(place, n)] = got[_ranges(first, n)]
    out = []
    edge = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        s = string[a:b]
        n = windows[s]
        flat = result[_ranges(w_first[s], n)]
        begin = np.ones(len(flat), bool)
        begin[1:] = flat[1:] != flat[:-1]
        begin[np.cumsum(n)[:-1]] = True
        f = np.flatnonzero(begin)
        out.append(_squeeze(np.array([len(f)], np.int64), f.astype(np.int64), flat[f]))
    return out


# ---------------------------------------------------------------- Spark stages


def _pack_batches(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
                w.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack", "bytes", "rows"])

        for b in batches:
            column = b.column(b.schema.get_field_index(text_col))
            offsets = text_buffers(column)[1]
            i = 0
            while i < b.num_rows:
                j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + PACK_BYTES - size, side="right")) - 1), b.num_rows)
                held.append(b.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                i = j
                if size >= PACK_BYTES * 3 // 4:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _open(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]


def _by_bucket(solve, schema: list[str]):
    """Rows (bucket, pack, blob, flags) sorted by bucket: ``solve`` gets a bucket's blobs and returns one per pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packs, blobs = None, [], []

        def finish() -> Iterator[pa.RecordBatch]:
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([current] * len(packs), pa.int32()), pa.array(solve(blobs), pa.binary())], schema)

        for b in batches:
            for bucket, pack, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != current:
                    yield from finish()
                    current, packs, blobs = bucket, [], []
                packs.append(pack)
                blobs.append(blob)
        yield from finish()

    return run


def _anchor_blob(u: np.ndarray, multi: np.ndarray) -> bytes:
    """Leading ANCHOR_BYTES of each digest, and the flags as bits."""
    lead = np.ascontiguousarray(u >> U64(64 - 8 * ANCHOR_BYTES)).view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES]
    return np.array([len(u)], np.int64).tobytes() + lead.tobytes() + np.packbits(multi).tobytes()


def _repeated_anchors(blobs: list[bytes]) -> list[bytes]:
    """For each pack's anchors: 1 where two documents of the corpus have it."""
    read = []
    for b in blobs:
        v = np.frombuffer(b, np.uint8)
        n = int(v[:8].view(np.int64)[0])
        short = np.zeros((n, 8), np.uint8)
        short[:, :ANCHOR_BYTES] = v[8 : 8 + ANCHOR_BYTES * n].reshape(n, ANCHOR_BYTES)
        read.append((short.view(U64)[:, 0], np.unpackbits(v[8 + ANCHOR_BYTES * n :], count=n).astype(bool)))
    every, multi = np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read])
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = s[1:] == s[:-1]
    hit = multi[order]
    hit[1:] |= same
    hit[:-1] |= same
    # one flag for all of a run: an anchor of two packs is in two documents
    first = np.flatnonzero(np.append(True, ~same)) if len(s) else np.zeros(0, np.int64)
    if len(first):
        hit = np.repeat(np.maximum.reduceat(hit, first), np.diff(np.append(first, len(s))))
    flags = np.empty(len(s), bool)
    flags[order] = hit
    edge = np.concatenate([[0], np.cumsum([len(r[0]) for r in read])])
    return [np.packbits(flags[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _unpack(pairs: list[dict]) -> dict[int, np.ndarray]:
    return {p["bucket"]: np.unpackbits(np.frombuffer(p["bits"], np.uint8)) for p in pairs or [] if p["bits"] is not None}


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """All columns of ``docs``, and: kept_bytes (binary), n_bytes, n_removed, n_spans, removed_spans.

    With ``as_text``, kept_text takes the place of kept_bytes; characters cut in
    two by the byte limits go as a whole.

    Texts are UTF-8 bytes (null: empty). Every byte covered by a ``width``-byte
    string that also starts in a document with a smaller id goes; strings are
    judged on the input and never cross documents. A null id counts as larger
    than any; rows that share an id do not remove each other's text. An empty
    table gives an empty result.

    Nothing but anchors (5 bytes for about every 18 of text, once per pack)
    and fragments of anchors that occur in two documents (once per pack) is
    shuffled by content, so that a hot passage sends one copy per pack; texts
    are shuffled twice, as compressed packs. Packs, answers and collections are
    bounded, but the fragments of one bucket must fit a task.
    """
    if not GRAM <= width <= 127:
        raise ValueError("width must be between 16 and 127")
    with Scratch(docs.sparkSession) as tmp:
        return tmp.keep(tmp.stored(_without_repeats(docs, tmp, width, id_col, text_col, as_text), "repeats", PACKS_AT_ONCE))


def _without_repeats(docs: DataFrame, tmp: Scratch, width: int, id_col: str, text_col: str, as_text: bool) -> DataFrame:
    """The rows of ``remove_repeats``, not yet computed; to be stored with PACKS_AT_ONCE rows a batch while ``tmp`` lives."""
    spark = docs.sparkSession
    source = docs.select(*[F.col(c) if c != text_col else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in docs.columns])
    packs = tmp.stored(source.mapInArrow(_pack_batches(text_col), "pack long, bytes long, rows binary"), "packs")
    buckets = max(12, -(-int(packs.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // BUCKET_BYTES))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = Pack(_open(raw), id_col, text_col, width).anchors(buckets)
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _, _ in parts], pa.int32()), pa.array([name] * len(parts), pa.int64()), pa.array([_anchor_blob(u, m) for _, u, m in parts], pa.binary())], ["bucket", "pack", "blob"]
                    )

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket", "pack")

    digests = packs.select("pack", "rows").mapInArrow(anchors, "bucket int, pack long, blob binary")
    bits = tmp.stored(dealt(digests).mapInArrow(_by_bucket(_repeated_anchors, ["pack", "bucket", "bits"]), "pack long, bucket int, bits binary"), "anchors", PACKS_AT_ONCE)
    told = bits.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw, flags in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                pack = Pack(_open(raw), id_col, text_col, width)
                parts = pack.repeated(buckets, _unpack(flags))
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(parts), pa.int32()), pa.array([name] * len(parts), pa.int64()), pa.array([pack.blob(p) for p in parts.values()], pa.binary())], ["bucket", "pack", "blob"]
                    )

    sent = packs.select("pack", "rows").join(told, "pack").select("pack", "rows", "bits").mapInArrow(send, "bucket int, pack long, blob binary")
    owners = tmp.stored(dealt(sent).mapInArrow(_by_bucket(lambda blobs: owners_of_bucket(blobs, width), ["pack", "bucket", "owners"]), "pack long, bucket int, owners binary"), "owners", PACKS_AT_ONCE)
    answers = bits.join(owners, ["pack", "bucket"]).groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits", "owners")).alias("answers"))

    out_schema = StructType(source.schema.fields[:])
    for name, kind in (("kept_text", "string") if as_text else ("kept_bytes", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("removed_spans", "array<struct<start:long,end:long>>")):
        out_schema = out_schema.add(name, kind if not kind.startswith("array") else spark.createDataFrame([], f"x {kind}").schema[0].dataType)
    arrow_schema = to_arrow_schema(out_schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, told_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                pack = Pack(_open(raw), id_col, text_col, width)
                own = {x["bucket"]: x["owners"] for x in told_ or []}
                cover = _cover(pack, pack.repeated(buckets, _unpack(told_)), own, width)
                yield from _finished(pack, cover, arrow_schema)

    return packs.select("pack", "rows").join(answers, "pack", "left").select("pack", "rows", "answers").mapInArrow(apply, out_schema)


def _cover(pack: Pack, parts: dict[int, tuple], owners: dict[int, bytes], width: int) -> np.ndarray:
    """For every byte of a pack, whether it goes."""
    gone = np.zeros(len(pack.data), np.int8)  # starts of removed windows
    for k, (hits, number, _, windows, _, _) in parts.items():
        v = _expand(owners[k])
        n = int(np.frombuffer(v[:8], np.int64)[0])
        run, who = np.frombuffer(v[8 : 8 + 8 * n], np.int64), np.frombuffer(v[8 + 8 * n :], np.int64)
        flat = np.repeat(who, np.diff(np.append(run, windows.sum())))  # owner of every window of the distinct fragments
        m = windows[number]
        theirs = flat[_ranges((np.cumsum(windows) - windows)[number], m)] < np.repeat(pack.ids[pack.row[hits]], m)
        gone[_ranges(pack.start[hits], m)[theirs]] = 1
    before = np.cumsum(gone, dtype=np.int32)
    cover = before > 0
    cover[width:] = before[width:] > before[:-width]
    return cover


def _finished(pack: Pack, cover: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n, off, n_own = pack.batch.num_rows, pack.offsets, pack.batch.num_columns
    kept, removed, spans = [], [], []
    for i in range(n):
        c, d = cover[off[i] : off[i + 1]], pack.data[off[i] : off[i + 1]]
        if c.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            removed.append(int(c.sum()))
            kept.append(d[~c].tobytes())
        else:
            spans.append([])
            removed.append(0)
            kept.append(d.tobytes())
    if schema.get_field_index("kept_text") == n_own:
        kept = [x.decode("utf-8", "ignore") for x in kept]
    extra = [pa.array(kept, schema.field(n_own).type), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, schema.field("removed_spans").type)]
    columns = [pack.batch.column(i) for i in range(pack.batch.num_columns)] + extra
    yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with Scratch(spark) as tmp:
        out = _without_repeats(docs, tmp, WIDTH, "doc_id", "text", False)
        return tmp.keep(tmp.stored(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256")), "repeats", PACKS_AT_ONCE))


#: Every 50-byte string by its place, as hexadecimal digits; texts are taken in pieces, so that no string is cut from the far end of a long one.
OP6_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, i * 1000 as base, substr(h, i * 2000 + 1, 2098) as h from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 50 + 1000, 0) // 1000 + 1)) as i from d where length(h) >= 100)),
w as (select doc_id, base + j as spot, substr(h, 2 * j + 1, 100) as s from (select doc_id, base, h, unnest(range(0, least(1000, greatest(length(h) // 2 - 49, 0)))) as j from p)),
o as (select s, min(doc_id) as least from w group by s having min(doc_id) < max(doc_id)),
g as (select w.doc_id, w.spot from w join o on w.s = o.s and o.least < w.doc_id),
r as (select doc_id, spot, case when spot - lag(spot) over (partition by doc_id order by spot) <= 50 then 0 else 1 end as fresh from g),
n as (select doc_id, spot, sum(fresh) over (partition by doc_id order by spot) as run from r),
x as (select doc_id, run, min(spot) as a, max(spot) + 50 as b from n group by all),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as c from x),
z as (select k.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as e, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' order by a) as kept from k join d using (doc_id) group by k.doc_id)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when e is null then h else kept || substr(h, 2 * e + 1) end)) as kept_sha256
from d left join z using (doc_id)
"""
