"""WARC archives: segmented, chunk-framed records written and put together again.

Writing: a record per row, HTTP response blocks with chunked transfer framing,
blocks longer than a segment split into a first record and continuation
records, one gzip member per record, through Spark's own committed writers, so
any file system that Spark can write will do and a lost executor only repeats
its task. Reading: files are parsed as a stream of gzip members, one record in
memory at a time; continuation records are grouped by origin identifier,
ordered by segment number, checked against the total length, and only then the
chunked framing is decoded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Scratch, broadcast_if_small, cut, step

CRLF = b"\r\n"
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2000-01-01T00:00:00Z"

#: Payloads shorter than this are never revisits (contract).
MIN_REVISIT = 1000



# ---------------------------------------------------------------- framing


def chunk_encode(body: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    out = bytearray()
    for i in range(0, len(body), size):
        part = body[i : i + size]
        out += b"%x\r\n" % len(part) + part + CRLF
    return bytes(out + b"0\r\n\r\n")


def chunk_decode(data: bytes) -> tuple[bytes, bool]:
    """(body, whole): what the chunks hold, and whether the framing was complete and well formed."""
    out, at = bytearray(), 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            return bytes(out), False
        try:
            n = int(data[at:end].split(b";", 1)[0].strip(), 16)
        except ValueError:
            return bytes(out), False
        at = end + 2
        if n == 0:  # trailers, then an empty line
            return bytes(out), data.startswith(CRLF, at) or data.find(CRLF + CRLF, at) >= 0
        out += data[at : at + n]
        if data[at + n : at + n + 2] != CRLF:
            return bytes(out), False
        at += n + 2


def http_payload(block: bytes) -> tuple[bytes, bool]:
    """(payload, whole) of an HTTP response block, its transfer framing decoded."""
    head, sep, body = block.partition(CRLF + CRLF)
    if not sep:
        return b"", False
    chunked = any(
        k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])
    )
    return chunk_decode(body) if chunked else (body, True)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n"
    raw = b"WARC/1.1\r\n" + head.encode("utf-8") + CRLF + block + CRLF + CRLF
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _urn(*key: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(key).encode()).digest()[:16])}>"


def _clean(text: str | None) -> str | None:
    """A header value: no line breaks."""
    return None if text is None else text.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _unclean(text: str | None) -> str | None:
    if text is None or "\\" not in text:
        return text
    return "".join({"\\\\": "\\", "\\r": "\r", "\\n": "\n"}.get(p, p) for p in re.split(r"(\\.)", text))


# ---------------------------------------------------------------- writing


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, top: ``top`` is the page that holds the payload.

    Among payloads equal by SHA-1 and length, of at least ``min_revisit``
    bytes, the largest page_id holds it. Only digests are grouped (map-side
    maxima). Groups of two and more are joined back, to the payloads of
    ``min_revisit`` bytes and more alone, so that empty pages are no hot key;
    the groups are broadcast if they are counted to be few.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = keyed.withColumn("digest", F.sha1("payload"))
    large = keyed.where(F.length("payload") >= min_revisit)
    shared = large.groupBy(F.col("digest").alias("d2")).agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1").select("d2", "top")
    told = large.join(broadcast_if_small(cut(shared)), F.col("digest") == F.col("d2"), "left").drop("d2")
    return told.unionByName(keyed.where(F.length("payload") < min_revisit).withColumn("top", F.lit(None).cast("long")))


def _write_batches(segment: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page_id, url, payload, digest, top, row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ident = _urn("page", page_id, digest)
                common = [("WARC-Date", RECORD_DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Instance", str(row))]
                if url is not None:
                    common.append(("WARC-Target-URI", _clean(url)))
                if page_id is not None:
                    common.append(("X-Page-ID", str(page_id)))
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if top is not None and page_id != top:
                    kind = [("WARC-Type", "revisit"), ("WARC-Record-ID", ident), ("WARC-Refers-To", _urn("page", top, digest)), ("WARC-Profile", REVISIT_PROFILE)]
                    out.append(_record(kind + common + [("Content-Type", "application/http; msgtype=response")], http))
                else:
                    block = http + chunk_encode(payload, chunk)
                    kind = [("WARC-Type", "response"), ("WARC-Record-ID", ident), ("Content-Type", "application/http; msgtype=response")]
                    if len(block) <= segment:
                        out.append(_record(kind + common, block))
                    else:
                        n = -(-len(block) // segment)
                        out.append(_record([*kind, *common, ("WARC-Segment-Number", "1")], block[:segment]))
                        for i in range(1, n):
                            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn("segment", ident, row, i)), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(i + 1)), ("X-Instance", str(row)), ("WARC-Date", RECORD_DATE)]
                            if i == n - 1:
                                more.append(("WARC-Segment-Total-Length", str(len(block))))
                            out.append(_record(more, block[i * segment : (i + 1) * segment]))
                size += sum(map(len, out[-1:]))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["member"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["member"])

    return run


def write_warc(pages: DataFrame, path: str, segment: int = 64 << 10, chunk: int = 8 << 10, per_file: int = 1024) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``.

    Null html is an empty payload; null url or page_id leave their header out;
    other columns are ignored; an empty table gives no records. Rows that
    repeat page_id and html are copies of one record: each is written, with the
    same identifier and another ``X-Instance``.

    Members go through the text writer: a member below 16 MB ends in a zero
    byte, the high byte of its length, which the writer appends as line
    separator. A file has at most ``per_file`` members of ``segment`` bytes.
    """
    assert 0 < segment < (16 << 20) - (64 << 10)
    rows = plan_records(pages).withColumn("row", F.monotonically_increasing_id())
    members = rows.select("page_id", "url", "payload", "digest", "top", "row").mapInArrow(_write_batches(segment, chunk), "member binary")
    with step(pages.sparkSession):
        members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").option("maxRecordsPerFile", per_file).text(path)


# ---------------------------------------------------------------- reading


def _members(content: bytes) -> Iterator[bytes]:
    """Decompressed gzip members, one at a time; plain WARC data passes as one."""
    if not content.startswith(b"\x1f\x8b"):
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        parts = []
        while not z.eof and at < len(view):
            step = view[at : at + (64 << 10)]
            parts.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        yield b"".join(parts)
        if not z.eof:
            return


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers by lower-case name, block, intact) of each record; damaged data ends its member."""
    for data in _members(content):
        at = 0
        while True:
            while data[at : at + 2] == CRLF:
                at += 2
            if not data.startswith(b"WARC/", at):
                break
            end = data.find(CRLF + CRLF, at)
            if end < 0:
                break
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            n = headers.get("content-length", "")
            n = int(n) if n.isdigit() else 0
            block = data[end + 4 : end + 4 + n]
            yield headers, block, len(block) == n
            at = end + 4 + n


_READ = pa.schema(
    [("file", pa.string()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("origin_id", pa.string()), ("instance", pa.string()), ("segment_number", pa.int32()), ("segment_total", pa.int64()), ("page_id", pa.int64()), ("block", pa.binary()), ("intact", pa.bool_())]
)
READ_DDL = "file string, record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, origin_id string, instance string, segment_number int, segment_total long, page_id long, block binary, intact boolean"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows: list[tuple] = []
            size = 0
            for h, block, intact in parse_records(content.as_py() or b""):
                digest = h.get("warc-payload-digest")
                rows.append(
                    (path, h.get("warc-record-id"), h.get("warc-type"), _unclean(h.get("warc-target-uri")), h.get("warc-refers-to"), digest and digest.partition(":")[2], h.get("warc-segment-origin-id"), h.get("x-instance"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), number(h.get("x-page-id")), block, intact)
                )
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path`` as they stand: headers that matter here and raw blocks.

    A file is one row of Spark's binary reader, so it must fit a task and be
    below 2 GB; ``write_warc`` keeps to 64 MB before compression, and
    ``stream_warc`` takes larger archives of others. To be read with few rows a
    batch (``util.step``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read_batches, READ_DDL)


#: What every record begins with; archives are read as rows between two of them.
_MARK = b"WARC/1."


def _stream_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, bytes between two marks), in order within a file -> records; a mark inside a block is put back."""
    number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
    file, parts, have, head, need = None, [], 0, None, 0  # of the record that is being put together

    def record() -> Iterator[pa.RecordBatch]:
        if head is None:
            return
        h, at = head
        block = b"".join(parts)[at : at + need]
        digest = h.get("warc-payload-digest")
        row = (file, h.get("warc-record-id"), h.get("warc-type"), _unclean(h.get("warc-target-uri")), h.get("warc-refers-to"), digest and digest.partition(":")[2], h.get("warc-segment-origin-id"), h.get("x-instance"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), number(h.get("x-page-id")), block, len(block) == need)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _READ, strict=True)], schema=_READ)

    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != file or (head is not None and have >= head[1] + need):
                yield from record()
                file, parts, have, head = name, [], 0, None
            if not parts and not re.match(rb"\d+\r\n", piece):
                continue  # before the first record, or the rest of one that another split has
            parts.append(_MARK + piece)
            have += len(_MARK) + len(piece)
            if head is None:
                raw = b"".join(parts) if len(parts) > 1 else parts[0]
                end = raw.find(CRLF + CRLF)
                if end >= 0:
                    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
                    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    n = headers.get("content-length", "")
                    head, need = (headers, end + 4), int(n) if n.isdigit() else 0
    yield from record()


def stream_warc(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_warc`` from .warc and .warc.gz files of any size, a record at a time in memory.

    Compressed files are decompressed as they stream by (Hadoop's codec, by
    the name's end), plain ones are split. A record of a plain file that holds
    the text 'WARC/1.' across the border of two splits comes out not intact.
    Damaged records end where their stated length ends, or the file. To be read
    with few rows a batch (``util.step``).
    """
    rows = spark.read.option("lineSep", _MARK.decode()).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.input_file_name().alias("file"), F.col("value").cast("binary")).mapInArrow(_stream_batches, READ_DDL)


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks put together, each byte copied once."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = b"".join(x.as_buffer() for x in batch.column(6)[i].values if x.is_valid) if batch.column(6)[i].is_valid else b""
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in range(6)], pa.array([block], pa.binary()), batch.column(7).slice(i, 1)], ["record_id", "warc_type", "target_uri", "refers_to", "payload_digest", "page_id", "block", "complete"])


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segmented ones put together by origin, the others as they are.

    Segments of one origin (and one ``X-Instance``, where a writer repeats a
    record) are ordered by segment number. ``complete`` is true if the first
    segment is there, numbers run from 1 without gap or repeat, every block has
    its stated length, and their lengths add up to the total that the last one
    states. Blocks of incomplete records hold what was found, in order. Only
    segmented records are shuffled.
    """
    cols = ["record_id", "warc_type", "target_uri", "refers_to", "payload_digest", "page_id"]
    plain = records.where("segment_number is null and coalesce(warc_type, '') <> 'continuation'").select(*cols, "block", F.col("intact").alias("complete"))
    seg = records.where("segment_number is not null or warc_type = 'continuation'").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = F.col("origin_id").isNull()
    part = F.struct("segment_number", "block", "intact")
    whole = (
        seg.groupBy("origin", "instance")
        .agg(
            *[F.max(F.when(first, F.col(c))).alias(c) for c in cols[1:]],
            F.array_sort(F.collect_list(part)).alias("parts"),
            F.max("segment_total").alias("total"),
            F.max(first).alias("has_first"),
        )
        .withColumn(
            "complete",
            F.col("has_first")
            & F.expr("transform(parts, x -> x.segment_number) = sequence(1, size(parts))")
            & F.expr("forall(parts, x -> x.intact)")
            & F.coalesce(F.expr("aggregate(parts, 0L, (n, x) -> n + length(x.block))") == F.col("total"), F.lit(False)),
        )
        .select(F.col("origin").alias("record_id"), *cols[1:], F.expr("transform(parts, x -> x.block)").alias("blocks"), F.coalesce("complete", F.lit(False)).alias("complete"))
    )
    joined = whole.mapInArrow(_join_batches, "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, page_id long, block binary, complete boolean")
    return plain.unionByName(joined)


_DECODED = "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, page_id long, payload binary, whole boolean"


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, whole = [], []
        for block, complete in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
            p, ok = http_payload(block or b"")
            payloads.append(p)
            whole.append(bool(ok and complete))
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.array(payloads, pa.binary()), pa.array(whole, pa.bool_())], ["record_id", "warc_type", "target_uri", "refers_to", "payload_digest", "page_id", "payload", "whole"])


def payloads(records: DataFrame) -> DataFrame:
    """``reassemble`` and decode the transfer framing: a row per record with its payload.

    ``whole`` is false where a segment is missing or the framing is damaged;
    the payload then holds what could be decoded.
    """
    return reassemble(records).mapInArrow(_decode_batches, _DECODED)


def resolve(decoded: DataFrame) -> DataFrame:
    """Per record: size and digest of the full payload, revisits looked up at the record they refer to.

    A revisit whose record is missing has null size and page; no records give
    no rows. Archives are read once: digests and sizes are stored, and only
    they are joined.
    """
    with Scratch(decoded.sparkSession) as tmp:
        return tmp.keep(tmp.stored(_resolved(decoded, tmp), "resolved"))


def _resolved(decoded: DataFrame, tmp: Scratch) -> DataFrame:
    d = decoded.select("record_id", "warc_type", "page_id", "refers_to", "whole", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"), "payload_digest")
    d = d.withColumn("whole", F.col("whole") & ((F.col("warc_type") != "response") | F.col("payload_digest").isNull() | (F.col("payload_digest") == F.col("digest"))))
    d = tmp.stored(d, "records", 64)
    own = d.where("warc_type = 'response'")
    base = own.groupBy(F.col("record_id").alias("base_id")).agg(F.max("page_id").alias("base_page"), F.max("n").alias("base_n"), F.max("digest").alias("base_digest"), F.min("whole").alias("base_whole"))
    back = d.where("warc_type = 'revisit'").join(base, F.col("refers_to") == F.col("base_id"), "left")
    return own.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "whole").unionByName(
        back.select("page_id", F.col("base_n").alias("payload_bytes"), F.col("base_digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("base_page").alias("refers_to"), F.coalesce(F.col("base_whole") & (F.col("base_digest") == F.col("payload_digest")), F.lit(False)).alias("whole"))
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as tmp:
        path = tmp.path("warc")
        write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
        return resolve(payloads(read_warc(spark, path)))


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
t as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id is distinct from top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from top then top end as refers_to, true as whole
from t
"""
