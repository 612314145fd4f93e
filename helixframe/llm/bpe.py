"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A word is a set of token-position rows. Each step of a recursive query joins
neighbouring tokens to the merge table and contracts every word's leftmost
pair of least rank, until no word has a pair left. Words are encoded once per
task and looked up after that. Decoding joins token rows to the vocabulary and
reads the pieces in order, so that a text's are one stretch of them.

Very long words go through the same query in windows. A sequence of tokens is
the encoding of its bytes if every two neighbours are the encoding of theirs:
merges happen in order of rank and place, so the first merge across a border
between two tokens would also happen if these two stood alone. Two windows that
overlap in a token are thus joined at it without changing a token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import stored

#: Words longer than LONG_WORD bytes go through the query in windows of WINDOW bytes.
LONG_WORD, WINDOW = 256, 128

#: Bytes of the words of one query; tokens of one decoding query. A cache above CACHE_WORDS starts anew.
BATCH_BYTES, BATCH_TOKENS, CACHE_WORDS = 1 << 18, 1 << 18, 400_000

#: ``key`` is word * 2**32 + pos, so one order serves all words; a pair is taken by its least rank * 2**32 + pos within the word.
ENCODE_SQL = """
with recursive step as (
  select word::bigint * 4294967296 + pos as key, id, false as done from bytes_
  union all
  select key, id, done from (
    with pairs as (
      select s.key, s.id, s.before, m.rank from (
        select key, id, case when (lead(key) over w) >> 32 = key >> 32 then lead(id) over w end as after, lag(key) over w as before from step where not done window w as (order by key)) s
      left join merges m on m.pair = s.id::bigint * 65536 + s.after),
    best as (select key >> 32 as word, min(rank::bigint * 4294967296 + (key & 4294967295)) as b from pairs group by 1)
    select p.key, case when b.b & 4294967295 = p.key & 4294967295 then (b.b >> 32)::int else p.id end as id, b.b is null as done
    from pairs p join best b on b.word = p.key >> 32 where b.b is null or p.before is null or p.before <> (p.key >> 32 << 32) + (b.b & 4294967295)))
select (key >> 32)::int as word, id from step where done order by key
"""

DECODE_SQL = "select row, piece from tokens_ join vocab using (id) order by pos"


@dataclass
class Vocabulary:
    """Token bytes by id, and the pattern that splits texts into words."""

    pieces: list[bytes | None]
    pattern: str
    pair: np.ndarray
    rank: np.ndarray

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file (a line per token: base64 bytes, rank). Read on the driver only."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 65536:
            raise ValueError("ids of 16 bits are needed")
        pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        pair, rank = [], []
        for token, r in ranks.items():
            pieces[r] = token
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pair.append(a * 65536 + b)
                    rank.append(r)
        return cls(pieces, pattern, np.array(pair, np.int64), np.array(rank, np.int32))

    @classmethod
    def public(cls, name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
        import public_tokenizers

        return cls.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


class Codec:
    """One DuckDB connection with the merge and vocabulary tables, and a bounded cache of words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import duckdb
        import regex

        self.split = regex.compile(vocabulary.pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.register("m_", pa.table({"pair": vocabulary.pair, "rank": vocabulary.rank}))
        self.db.execute("create table merges as select pair, rank from m_")
        known = [(i, p) for i, p in enumerate(vocabulary.pieces) if p is not None]
        self.db.register("v_", pa.table({"id": pa.array([i for i, _ in known], pa.int32()), "piece": pa.array([p for _, p in known], pa.binary())}))
        self.db.execute("create table vocab as select * from v_")
        self.whole = {p: i for i, p in known}
        self.byte_id = np.array([self.whole[bytes([i])] for i in range(256)], np.int32)
        self.size = np.array([len(p or b"") for p in vocabulary.pieces], np.int64)
        self.cache: dict[str, bytes] = {}

    def _rows(self, words: list[bytes]) -> pa.Table:
        lens = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
        return pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), lens), "pos": pos.astype(np.int32), "id": self.byte_id[data]})

    def _raw(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as ``encode`` gives them, by the recursive query, a bounded number of bytes at a time."""
        out: list[bytes] = []
        i = 0
        while i < len(words):
            j, size = i, 0
            while j < len(words) and (j == i or size + len(words[j]) <= BATCH_BYTES):
                size += len(words[j])
                j += 1
            self.db.register("bytes_", self._rows(words[i:j]))
            got = self.db.sql(ENCODE_SQL).to_arrow_table()
            raw = got.column("id").to_numpy().astype("<u4").tobytes()
            edge = (np.searchsorted(got.column("word").to_numpy(), np.arange(j - i + 1)) * 4).tolist()
            out += [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            i = j
        return out

    def _query(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int32) for x in self._raw(words)]

    def _places(self, ids: np.ndarray, start: int) -> np.ndarray:
        """Where each token starts, and where the last one ends."""
        return start + np.concatenate([[0], np.cumsum(self.size[ids])])

    def _windows(self, data: bytes) -> np.ndarray | None:
        """Ids of a long word: windows, and for each seam a stretch from a token of one window to a token of the next; None if some don't meet."""
        cut = list(range(0, len(data), WINDOW))
        known: dict[bytes, np.ndarray] = {}

        def encoded(parts: list[bytes]) -> list[np.ndarray]:
            new = list(dict.fromkeys(x for x in parts if x not in known))
            known.update(zip(new, self._query(new), strict=True))
            return [known[x] for x in parts]

        ids = encoded([data[a : a + WINDOW] for a in cut])
        at = [self._places(x, a) for x, a in zip(ids, cut, strict=True)]
        first = [min(int(np.searchsorted(p[:-1], a + WINDOW // 2)), len(x) - 1) for x, p, a in zip(ids, at, cut, strict=True)]  # a token of the later half
        ends = [int(p[min(int(np.searchsorted(p[1:], a + WINDOW // 2)), len(x) - 1) + 1]) for x, p, a in zip(ids, at, cut, strict=True)]
        begin = [int(p[f]) for p, f in zip(at[:-1], first[:-1], strict=True)]
        seams = encoded([data[a:b] for a, b in zip(begin, ends[1:], strict=True)])
        out, done = [], 0  # tokens of the current window before ``done`` are written
        for i, seam in enumerate(seams):
            p = self._places(seam, begin[i])
            left = np.searchsorted(at[i][:-1], p[:-1])
            ok = (left < len(ids[i])) & (p[:-1] < cut[i + 1])
            left = np.minimum(left, len(ids[i]) - 1)
            ok &= (at[i][left] == p[:-1]) & (ids[i][left] == seam) & (left >= done)
            right = np.searchsorted(at[i + 1][:-1], p[:-1])
            ok2 = (right < len(ids[i + 1])) & (p[:-1] >= cut[i + 1])
            right = np.minimum(right, len(ids[i + 1]) - 1)
            ok2 &= (at[i + 1][right] == p[:-1]) & (ids[i + 1][right] == seam)
            if not ok.any() or not ok2.any():
                return None
            x, y = int(np.argmax(ok)), int(np.argmax(ok2))
            out += [ids[i][done : left[x]], seam[x:y]]
            done = int(right[y])
        out.append(ids[-1][done:])
        return np.concatenate(out)

    def _scan(self, data: bytes) -> np.ndarray:
        """Ids of a long word from left to right: each window starts at a token of the one before and must begin with it again."""
        known: dict[bytes, np.ndarray] = {}
        out, size, back = np.zeros(0, np.int32), 2 * WINDOW, 1
        start = 0  # of the last token of ``out``, or of the word
        while True:
            part = data[start : start + size]
            if part not in known:
                if len(known) > 4096:
                    known.clear()
                known[part] = self._query([part])[0]
            ids = known[part]
            if len(out) and ids[0] != out[-1]:  # more of what comes before is needed
                back, size = 2 * back, 2 * size
                out = out[: max(0, len(out) - back)]
                start = int(self._places(out, 0)[-2]) if len(out) else 0
                continue
            if start + size >= len(data):
                return np.concatenate([out[:-1], ids])
            ends = self._places(ids, 0)[1:]
            y = int(np.searchsorted(ends, size * 3 // 4, side="right")) - 1
            if y < 1:
                size *= 2
                continue
            out = np.concatenate([out[:-1], ids[: y + 1]])
            start += int(ends[y - 1])
            size, back = 2 * WINDOW, 1

    def learn(self, words: list[str]) -> None:
        """Encode words that are not in the cache."""
        short, long = [], []
        for w in words:
            data = w.encode("utf-8")
            if (i := self.whole.get(data)) is not None:  # a word that is a token needs no merges
                self.cache[w] = i.to_bytes(4, "little")
            else:
                (short if len(data) <= LONG_WORD else long).append((w, data))
        short.sort(key=lambda x: len(x[1]))  # a query takes as many steps as its longest word
        self.cache.update(zip([w for w, _ in short], self._raw([d for _, d in short]), strict=True))
        for w, data in long:
            ids = self._windows(data)
            self.cache[w] = (self._scan(data) if ids is None else ids).astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split, cache = self.split, self.cache
        parts = [split(t) for t in texts]
        new = set().union(*parts) - cache.keys() if parts else set()
        self.learn(sorted(new))
        return [b"".join(map(cache.__getitem__, p)) for p in parts]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence; an id that is not in the vocabulary adds nothing."""
        parts = [x[i : i + 4 * BATCH_TOKENS] for x in ids for i in range(0, max(len(x), 1), 4 * BATCH_TOKENS)]
        done: list[bytes] = []
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= 4 * BATCH_TOKENS):
                size += len(parts[j])
                j += 1
            done += self._pieces(parts[i:j])
            i = j
        it = iter(done)
        return [b"".join(next(it) for _ in range(0, max(len(x), 1), 4 * BATCH_TOKENS)) for x in ids]

    def _pieces(self, ids: list[bytes]) -> list[bytes]:
        lens = np.array([len(x) // 4 for x in ids], np.int64)
        if not lens.sum():
            return [b""] * len(ids)
        flat = np.frombuffer(b"".join(x[: 4 * n] for x, n in zip(ids, lens, strict=True)), "<u4").astype(np.int32)
        self.db.register("tokens_", pa.table({"row": np.repeat(np.arange(len(ids), dtype=np.int32), lens), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        got = self.db.sql(DECODE_SQL).to_arrow_table()
        if not got.num_rows:
            return [b""] * len(ids)
        edge = np.searchsorted(got.column("row").to_numpy(), np.arange(len(ids) + 1))
        pieces = pa.concat_arrays(got.column("piece").chunks)
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1][edge].tolist()
        raw = memoryview(pieces.buffers()[2])
        return [bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _chunks(texts: list[str], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: every whole text's ids as little-endian unsigned 32-bit integers, without special tokens.

    Null and empty texts have no ids; repeated rows are encoded alike; other
    columns are ignored; an empty table gives an empty result. No shuffle; a
    task holds one batch of texts and a cache of at most CACHE_WORDS words and
    one batch's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(codec.encode(texts[i:j]), pa.binary())], ["doc_id", "ids"])

    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary"), "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, data: the bytes that the ids stand for (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            start = 0
            while start < len(ids):
                end, size = start, 0
                while end < len(ids) and (end == start or size + len(ids[end]) <= 4 << 20):
                    size += len(ids[end])
                    end += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), pa.array(codec.decode(ids[start:end]), pa.binary())], ["doc_id", "ids", "data"])
                start = end

    return stored(encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, data binary"), "decoded")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids alone.

    Both in one pass with one codec, so a task has one Python worker and one
    set of tables. Nulls, repeats, extra columns and empty tables as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _chunks(texts, 2 << 20):
                ids = codec.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array(codec.decode(ids), pa.binary())], ["doc_id", "ids", "data"])

    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, data binary")
    digests = both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
    return stored(digests, "tokens")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, Vocabulary.public())


#: Unicode white space, and a character that no text holds, put between the white space that stands alone and that before a word.
_SPACE, _STOP = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", 0x10FFFF

_OP9_SQL = r"""
with recursive vocab as (select hex(from_base64(b64)) as piece, id from read_csv('{path}', delim=' ', header=false, quote='', escape='', columns={{'b64': 'varchar', 'id': 'int'}})),
t as (select doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '([{space}]+)([{space}])([^{space}])', '\1' || chr({stop}) || '\2\3', 'g'),
  '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}\x{{10FFFF}}]+|[{space}]+') as ws from documents),
u as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from t),
v as (select row_number() over () as word, w, hex(encode(w)) as h from (select distinct w from u)),
step as (
  select word, p as pos, substr(h, 2 * p::int + 1, 2) as piece, false as done from (select word, h, unnest(range(length(h) // 2)) as p from v)
  union all
  select word, pos, piece, done from (
    with pairs as (
      select s.word, s.pos, s.piece, s.before, s.both, m.id from (
        select word, pos, piece, piece || lead(piece) over w as both, lag(pos) over w as before from step where not done window w as (partition by word order by pos)) s
      left join vocab m on m.piece = s.both),
    best as (select word, min(id::bigint * 4294967296 + pos) as b from pairs group by word)
    select p.word, p.pos, case when b.b % 4294967296 = p.pos then p.both else p.piece end as piece, b.b is null as done
    from pairs p join best b on b.word = p.word where b.b is null or p.before is null or p.before <> b.b % 4294967296)),
e as (select word, count(*) as n, string_agg(printf('%02X%02X0000', id % 256, id // 256), '' order by pos) as ids, string_agg(piece, '' order by pos) as back from step join vocab using (piece) where done group by word),
x as (select doc_id, sum(n)::bigint as n, string_agg(ids, '' order by i) as ids, string_agg(back, '' order by i) as back from u join v using (w) join e using (word) group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_tokens, sha256(unhex(coalesce(ids, ''))) as ids_sha256, sha256(unhex(coalesce(back, ''))) as decoded_sha256 from documents left join x using (doc_id)
"""


def op9_sql() -> str:
    """The same recursion over the distinct words of ``documents``; the pattern's look-ahead is written as a mark in the text."""
    import public_tokenizers

    return _OP9_SQL.format(path=public_tokenizers.path("byte_bpe_50k.tiktoken"), space=_SPACE, stop=_STOP)
