"""Near-duplicate documents by a chosen-path set similarity join.

Texts with equal shingle sets form one class. Classes are embedded as minwise
tokens; in each of several independent trees a class goes down from node to
node by the minwise tokens at positions that the node itself selects, so two
similar sets stay together along some path. Small nodes are compared
exhaustively, nodes in which nearly all are close to one member are compared
against that member first and then across what is still apart, all others
branch again. Candidates are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytefeat import U64, lower_ascii, mix64, pieces, shingle_hashes, span_hashes, text_buffers, words
from .util import BROADCAST_IDS, Scratch, broadcast_if_small, connected_components, cut, pieces_of, rekeyed, shared_keys

#: Minwise tokens per set, trees, branches a node selects, levels before sizes are looked at.
TOKENS, TREES, BRANCHES, FIRST_LEVELS = 64, 5, 2, 3

#: Members of a large node that are tried as its head.
HEADS = 4

#: Nodes up to this size are compared by their tokens in one piece; no branch is followed beyond MAX_LEVEL.
NODE_LIMIT, MAX_LEVEL = 64, 12

#: Candidates are confirmed if this share of minwise tokens agrees: five standard deviations below 0.8.
LEAST_AGREE = 0.55

#: Classes of a dense node that one task compares with as many others on full sets.
DENSE_CHUNK = 2048

#: Bytes of a shingle hash in the sets that travel: two shingles of a pair of texts of 1,000 are taken for one with probability 2e-9.
SET_BYTES = 6

#: Node rows of a task; rows of dense tiles of a task.
TASK_ROWS, TILE_ROWS = 20_000, 4 * DENSE_CHUNK

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: lower-cased A-Z, words between ASCII white space."""
    low = lower_ascii(data)
    s, e, row = words(low, offsets)
    h, r = shingle_hashes(span_hashes(low, s, e), row, len(offsets) - 1, k)
    edge = np.searchsorted(r, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x TOKENS minwise tokens (uint32); zeros for empty sets."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    full = [i for i, x in enumerate(sets) if len(x)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        with np.errstate(over="ignore"):
            for j in range(TOKENS):
                out[full, j] = np.minimum.reduceat((((flat ^ _XOR[j]) * _MUL[j]) >> U64(32)).astype(np.uint32), at)
    return out


def _set_key(x: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set, as signed integers."""
    with np.errstate(over="ignore"):
        a = mix64(mix64(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)[None] + U64(len(x)))
        b = mix64(x * U64(0xDA942042E4DD58B5)).sum(dtype=U64)[None]
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _children(node: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """Keys of the child nodes: a node selects BRANCHES positions by its own key, alike for all its members."""
    out = []
    with np.errstate(over="ignore"):
        first = mix64(node ^ U64(0xA0761D6478BD642F))
        pos = (first % U64(TOKENS)).astype(np.int64)
        step = (mix64(first) % U64(TOKENS - 1)).astype(np.int64) + 1  # distinct positions
        for b in range(BRANCHES):
            p = (pos + b * step) % TOKENS
            token = sig[np.arange(len(sig)), p].astype(U64)
            out.append(mix64(node * U64(0x9E3779B97F4A7C15) + (p.astype(U64) << U64(32)) + token + U64(1)))
    return out


def _feature_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column(1))
            for i, j in pieces(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                sig = signatures(sets)
                keys = [_set_key(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([a for a, _ in keys], pa.int64()),
                        pa.array([b for _, b in keys], pa.int64()),
                        pa.array([r.tobytes() for r in sig], pa.binary()),
                        pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "cls", "check", "sig", "low"],
                )

    return run


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _low(column: pa.Array) -> np.ndarray:
    """The tokens' low bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, TOKENS)


def _pack_set(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def _open_set(raw: pa.Scalar) -> np.ndarray:
    part = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, SET_BYTES)
    full = np.zeros((len(part), 8), np.uint8)
    full[:, :SET_BYTES] = part
    return np.unique(full.view(U64)[:, 0])


def _root_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, sig = np.asarray(batch.column(0)), _sig(batch.column(1))
        for tree in range(TREES):
            level = [np.full(len(cls), mix64(np.array([tree + 1], U64))[0], U64)]
            for _ in range(FIRST_LEVELS):
                level = [c for node in level for c in _children(node, sig)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(level).view(np.int64)), pa.array(np.tile(cls, len(level)))], ["node", "cls"])


def _branch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        node, cls, sig = np.asarray(batch.column(0)).view(U64), np.asarray(batch.column(1)), _sig(batch.column(2))
        kids = _children(node, sig)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kids).view(np.int64)), pa.array(np.tile(cls, len(kids)))], ["node", "cls"])


def _agree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, low bytes of a member, those of its node's heads -> node, summed share of tokens that agree with each head, members: a row per batch and node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, at = np.unique(np.asarray(batch.column(0)), return_inverse=True)
        low = _low(batch.column(1))
        sums = [pa.array(np.bincount(at, (low == _low(batch.column(2 + i))).mean(1))) for i in range(HEADS)]
        yield pa.RecordBatch.from_arrays([pa.array(node), *sums, pa.array(np.bincount(at))], ["node", *[f"a{i}" for i in range(HEADS)], "members"])


def leaves(reps: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(small, dense) terminal nodes of all trees: node, cls, those of dense ones with the node's head. ``reps``: cls, sig, low (stored).

    A large node branches while that shrinks it: members that agree with one of
    them in a share a of the tokens come back BRANCHES * a times on the next
    level. If that is once or more on average for one of HEADS members, the
    node is dense and compared as it is, first with that one, its head. Sizes,
    heads and shares are aggregates that combine before the shuffle, so
    no node is ever gathered in a task here.
    """
    rows = reps.select("cls", "sig").mapInArrow(_root_batches, "node long, cls long")
    small, dense, level = [], [], FIRST_LEVELS
    while True:
        size = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        sized = tmp.stored(rows.join(size, "node"), "nodes", 4096)
        small.append(sized.where(F.col("size") <= NODE_LIMIT).select("node", "cls"))
        large = sized.where(F.col("size") > NODE_LIMIT).select("node", "cls")
        if large.isEmpty():
            break
        if level == FIRST_LEVELS:  # classes of deeper large nodes are among those of the first
            reps = tmp.stored(reps.join(broadcast_if_small(cut(large.select("cls").distinct()), BROADCAST_IDS), "cls", "left_semi"), "crowded")
        big = tmp.stored(large.join(reps, "cls").select("node", "cls", "sig", "low"), "large")
        pick = [F.min_by(F.struct("cls", "low"), F.xxhash64("cls", F.lit(i))).alias(f"h{i}") for i in range(HEADS)]
        heads = broadcast_if_small(cut(big.groupBy("node").agg(*pick)))
        shares = big.select("node", "low").join(heads, "node").select("node", "low", *[F.col(f"h{i}.low").alias(f"l{i}") for i in range(HEADS)]).mapInArrow(_agree_batches, f"node long, {''.join(f'a{i} double, ' for i in range(HEADS))}members long")
        best = F.greatest(*[F.struct((F.sum(f"a{i}") / F.sum("members")).alias("agree"), F.lit(i).alias("i")) for i in range(HEADS)])
        told = shares.groupBy("node").agg(best.alias("best")).where((F.col("best.agree") * BRANCHES >= 1) | F.lit(level >= MAX_LEVEL))
        head = F.coalesce(*[F.when(F.col("best.i") == i, F.col(f"h{i}.cls")) for i in range(HEADS)])
        tight = broadcast_if_small(cut(told.join(heads, "node").select("node", head.alias("head")), 4096))
        dense.append(big.join(tight, "node").select("node", "cls", "head"))
        if level >= MAX_LEVEL:
            break
        rows = big.join(tight, "node", "left_anti").select("node", "cls", "sig").mapInArrow(_branch_batches, "node long, cls long")
        level += 1

    none = small[0].withColumn("head", F.col("cls")).limit(0)
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, dense, none)


def _grouped(columns: int, solve):
    """Rows sorted by their first ``columns`` integer columns: ``solve`` gets the rows of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(columns)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if (key := tuple(keys[a])) != current:
                    if held and (out := solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
                        yield out
                    held, current = [], key
                held.append(batch.slice(a, b - a))
        if held and (out := solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
            yield out

    return run


def _pairs(cls: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], ["a", "b"]) if len(i) else None


def _forest(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(i, j) of all likely pairs, and which of them make a spanning forest, likeliest first."""
    agree = np.stack([(low == row).mean(1) for row in low])
    i, j = np.nonzero(np.triu(agree >= LEAST_AGREE, 1))
    label, keep = np.arange(len(low)), []
    for k in np.argsort(-agree[i, j], kind="stable"):
        a, b = label[i[k]], label[j[k]]
        if a != b:
            label[label == b] = a
            keep.append(int(k))
    return i, j, keep


def _likely_forest(t: pa.RecordBatch) -> pa.RecordBatch | None:
    """Of a small node: the pairs of a spanning forest of likely links, likeliest first."""
    cls, low = np.asarray(t.column(1)), _low(t.column(2))
    i, j, keep = _forest(low)
    return _pairs(cls, i[keep], j[keep])


def _likely_across(t: pa.RecordBatch) -> pa.RecordBatch | None:
    """Of a small node: all likely pairs of different components, those of its forest, tried before, left out."""
    cls, low, comp = np.asarray(t.column(1)), _low(t.column(2)), np.asarray(t.column(3))
    if (comp == comp[0]).all():
        return None
    i, j, keep = _forest(low)
    on = comp[i] != comp[j]
    on[keep] = False
    return _pairs(cls, i[on], j[on])


def _similar(x: int, y: np.ndarray, both: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    return denominator * both >= numerator * (x + y - both)


def _dense_links(numerator: int, denominator: int):
    """One tile of a dense node on full sets: pairs that join its members into their components.

    Members already joined, those of the core among them, are not compared
    again, so a group of near copies costs about one comparison each.
    """

    def solve(t: pa.RecordBatch) -> pa.RecordBatch | None:
        same = t.column(1)[0].as_py() == t.column(2)[0].as_py()
        side, cls, low = np.asarray(t.column(3)), np.asarray(t.column(4)), _low(t.column(5))
        core = np.asarray(t.column(6).to_pylist(), bool)
        sets = [_open_set(x) for x in t.column(7)]
        size = np.array([len(x) for x in sets])
        item, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1  # items of one set only don't matter
        row = np.repeat(np.arange(len(sets)), size)
        on = count[number] > 1
        width = (int((count > 1).sum()) + 63) // 64
        bits = None
        if len(sets) * width * 8 <= 128 << 20:
            place = shared[number[on]]
            bits = np.zeros((len(sets), max(1, width)), U64)
            np.bitwise_or.at(bits, (row[on], place >> 6), U64(1) << (place & 63).astype(U64))
        label, out_i, out_j = np.arange(len(cls)), [], []
        label[core] = len(cls)  # linked with the head, so one component already
        for i in range(len(cls)):
            if not same and side[i] == 1:
                continue
            c = label != label[i]
            c[: i + 1] &= not same
            if not same:
                c &= side == 1
            c &= (denominator * np.minimum(size, size[i]) >= numerator * np.maximum(size, size[i])) & ((low == low[i]).mean(1) >= LEAST_AGREE)
            j = np.flatnonzero(c)
            if not len(j):
                continue
            if bits is not None:
                both = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
            else:
                both = np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in j])
            for k in j[_similar(size[i], size[j], both, numerator, denominator)]:
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    out_i.append(i)
                    out_j.append(k)
        return _pairs(cls, np.array(out_i, np.int64), np.array(out_j, np.int64))

    return solve


def _verify_batches(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _open_set(x), _open_set(y)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(bool(_similar(len(x), len(y), both, numerator, denominator)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column(1))
            for i, j in pieces(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                keys = [_set_key(x) for x in sets]
                yield pa.RecordBatch.from_arrays([*[pa.array([key[i] for key in keys], pa.int64()) for i in (0, 1)], pa.array([_pack_set(x) for x in sets], pa.binary())], ["cls", "check", "set"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two texts are linked if denominator * intersection >= numerator * union of
    their sets of k-word shingles (words between ASCII white space, A-Z
    lowered; fewer words: the whole sequence is the one shingle). A text
    without words links with nothing, not even its like; a null text is
    empty. component_id is the smallest doc_id reachable by links; rows that
    repeat a text or a doc_id are rows of their own. Null ids never name a
    component of others. Other columns are ignored; an empty table gives an
    empty result.

    Equal sets are one class from the start (hot groups of copies are grouped
    by partial aggregation). Node rows are (key, class) pairs; tokens join only
    nodes of two members or more, full sets only classes with a likely
    partner. Of a small node, a spanning forest of likely pairs is confirmed
    first, then what is likely across the components that are left. Of a dense
    node, every member is confirmed against the head, and only the others, if
    any, meet all members in tiles of two chunks of full sets. The similarity
    must be 0.8 or more for the token filter to hold. Sets are compared by 48
    bits a shingle.
    """
    if numerator < 0.8 * denominator:
        raise ValueError("the token filter is set for similarities of 0.8 and more")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as tmp:
        feats = tmp.stored(source.mapInArrow(_feature_batches(k), "doc_id long, n_shingles long, cls long, check long, sig binary, low binary"), "shingles")
        classes = (
            feats.where("n_shingles > 0")
            .groupBy("cls", "check", "n_shingles")
            .agg(F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(2**62)).alias("o"), "sig", "low")).alias("s"))
            .select("cls", "check", "least", "s.sig", "s.low")
        )
        classes = tmp.stored(classes, "classes")
        shared = shared_keys(classes)
        feats, classes = rekeyed(feats, shared), rekeyed(classes, shared)
        low = classes.select("cls", "low")
        small, dense = leaves(classes.select("cls", "sig", "low"), tmp)
        dense = tmp.stored(dense, "dense")
        placed = tmp.stored(small.join(low, "cls").select("node", "cls", "low"), "placed")
        tasks = pieces_of(spark, placed.count(), TASK_ROWS)

        def by_node(rows: DataFrame, solve) -> DataFrame:
            """Pairs that ``solve`` finds in each node, whose rows are together and in order of class."""
            return rows.repartition(tasks, "node").sortWithinPartitions("node", "cls").mapInArrow(_grouped(1, solve), "a long, b long").distinct()

        forest = tmp.stored(by_node(placed, _likely_forest), "pairs", 4096)

        # the full sets of all classes with a likely partner: a text of each, found by its id (null ids are looked up, too)
        wanted = forest.select(F.col("a").alias("cls")).union(forest.select("b")).union(dense.select("cls")).distinct()
        wanted = cut(wanted.join(classes.select("cls", "least"), "cls"))
        ids = broadcast_if_small(cut(wanted.select("least").distinct()), BROADCAST_IDS)  # so that texts stay where they are
        texts = source.join(ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").mapInArrow(_set_batches(k), "cls long, check long, set binary")
        sets = tmp.stored(rekeyed(texts, shared).select("cls", "set").join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")

        def confirmed(pairs: DataFrame, name: str) -> DataFrame:
            a, b = sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b"))
            return tmp.stored(pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(_verify_batches(numerator, denominator), "a long, b long"), name, 64)

        links = confirmed(forest, "links")
        tmp.drop(forest)
        if not dense.isEmpty():
            headed = dense.select("node", "cls", F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b"))
            star = confirmed(headed.where("a < b").select("a", "b").distinct(), "star")
            member = tmp.stored(headed.join(star.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("node", "cls", (F.col("linked").isNotNull() | (F.col("a") == F.col("b"))).alias("core")), "members")
            n = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / DENSE_CHUNK).cast("int")
            chunks = cut(member.groupBy("node").agg(n(~F.col("core")).alias("n0"), n(F.col("core")).alias("n1"), F.count("*").alias("size")).where("n0 > 0"))
            total = chunks.agg(F.sum(F.col("size") * F.col("n0"))).first()[0] or 0
            tiles = member.join(broadcast_if_small(chunks), "node")
            own = F.when(F.col("core"), F.col("n0") + F.pmod(F.xxhash64("cls"), F.col("n1"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("n0"))).cast("int")
            tiles = tiles.withColumn("own", own)
            other = F.filter(F.sequence(F.lit(0), F.col("n0") + F.col("n1") - 1), lambda j: F.least(j, F.col("own")) < F.col("n0"))
            tiles = tiles.withColumn("j", F.explode(other)).select(
                "node", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), (F.col("own") > F.col("j")).cast("int").alias("side"), "cls", "core"
            )
            rows = tiles.join(low, "cls").join(sets, "cls").select("node", "i", "j", "side", "cls", "low", "core", "set")
            rows = rows.repartition(pieces_of(spark, 2 * total, TILE_ROWS), "node", "i", "j").sortWithinPartitions("node", "i", "j", "cls")
            found = tmp.stored(rows.mapInArrow(_grouped(3, _dense_links(numerator, denominator)), "a long, b long"), "found")
            links = tmp.stored(links.unionByName(star).unionByName(found), "links")
            tmp.drop(member, star, found)
        comps = cut(connected_components(links))

        # what is likely across the components that a small node still holds; members keep their order, so the forest is the same
        member = placed.join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left").select("node", "cls", "low", F.coalesce("component", "cls").alias("comp"))
        more = confirmed(cut(by_node(member, _likely_across), 4096), "more")
        if not more.isEmpty():
            comps = cut(connected_components(links.unionByName(more)))

        owner = (
            classes.select("cls", "least")
            .join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left")
            .withColumn("component", F.coalesce("component", "cls"))
        )
        least = owner.groupBy("component").agg(F.min("least").alias("component_id"))
        named = owner.join(least, "component").select(F.col("cls").alias("cls2"), "component_id")
        out = feats.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls")).join(named, F.col("cls") == F.col("cls2"), "left")
        comp = F.coalesce("component_id", "doc_id")
        out = out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, comp.isNull()).alias("kept"))
        return tmp.keep(tmp.stored(out, "near"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4)


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as seen from documents union select r.node, e.b from r join e on e.a = r.seen)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join (select node, min(seen) as component_id from r group by node) c on c.node = d.doc_id
"""
