"""Reads from SAM text and BAM files.

BAM is read by a Python data source. A whole file is split at BGZF blocks: each
task seeks to the first block at or after its range, finds the first record
there, and stops at the first record that starts beyond its range. A region is
read through the file's index: only the stretches that can hold its reads are
opened, and they begin at records. Files are local, mounted, or anything that
Arrow's file systems open by URI.
"""

from __future__ import annotations

import fnmatch
import gzip
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import cell_label
from ..schemas import READS

#: Fixed values of the BAM format: letters of the 4-bit bases and of the CIGAR operations.
SEQ_CODES = "=ACMGRSVTWYHKDBN"
CIGAR_CODES = "MIDNSHP=X"

#: Compressed bytes of a task's range.
SPLIT = 32 << 20


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text files."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("@")).select(f.alias("f"), F.input_file_name().alias("file")).where(F.size("f") >= 11).select(
        F.col("f")[0].alias("qname"), F.col("f")[1].try_cast("int").alias("flag"), F.col("f")[2].alias("rname"), F.col("f")[3].try_cast("int").alias("pos"), F.col("f")[4].try_cast("int").alias("mapq"),
        F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), F.col("f")[10].alias("qual"), "file",
    ).where("flag is not null and pos is not null")


def with_cell(reads: DataFrame) -> DataFrame:
    """Reads with the cell that their file's name tells."""
    return reads.withColumn("cell", cell_label(F.col("file")))


def bgzf_blocks(raw: bytes, at: int = 0) -> Iterator[tuple[int, int]]:
    """(offset, size) of consecutive BGZF blocks."""
    while at + 18 <= len(raw):
        if raw[at : at + 4] != b"\x1f\x8b\x08\x04":
            return
        (xlen,) = struct.unpack_from("<H", raw, at + 10)
        extra, size, i = raw[at + 12 : at + 12 + xlen], None, 0
        while i + 4 <= len(extra):
            sub, n = extra[i : i + 2], struct.unpack_from("<H", extra, i + 2)[0]
            if sub == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + n
        if size is None or at + size > len(raw):
            return
        yield at, size
        at += size


def write_bgzf(data: bytes, path: str, block: int = 60_000) -> None:
    """``data`` as BGZF (for tests and small exports)."""
    with open(path, "wb") as out:
        for i in [*range(0, len(data), block), None]:
            part = b"" if i is None else data[i : i + block]
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = z.compress(part) + z.flush()
            out.write(b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system of a path or URI, and the path in it."""
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _open(path: str):
    fs, inner = _at(path)
    return fs.open_input_file(inner)


def _size(path: str) -> int:
    fs, inner = _at(path)
    info = fs.get_file_info(inner)
    if info.type != pa.fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def bam_files(path: str) -> list[str]:
    """The .bam files that a path stands for, sorted: a file, all of a folder, or a glob in the last part. FileNotFoundError if there are none."""
    prefix = re.match(r"\w+://[^/]*", path)
    fs, inner = _at(path)
    named = lambda p: f"{prefix[0]}/{p.lstrip('/')}" if prefix and not path.startswith("file:") else p
    info = fs.get_file_info(inner)
    if info.type == pa.fs.FileType.File:
        return [path]
    folder, pattern = (inner, "*.bam") if info.type == pa.fs.FileType.Directory else os.path.split(inner)
    if fs.get_file_info(folder).type != pa.fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = sorted(named(f.path) for f in fs.get_file_info(pa.fs.FileSelector(folder)) if f.type == pa.fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name.endswith(".bam"))
    if not found:
        raise FileNotFoundError(f"no .bam file under {path}")
    return found


def has_index(path: str) -> bool:
    """Whether a BAM file has its index beside it (x.bam.bai or x.bai)."""
    return index_path(path) is not None


def index_path(path: str) -> str | None:
    for p in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        fs, inner = _at(p)
        if fs.get_file_info(inner).type == pa.fs.FileType.File:
            return p
    return None


# Fixed values of the index format: bins of 16 kb, 128 kb, 1 Mb, 8 Mb, 64 Mb and 512 Mb, numbered from the widest; windows of 16 kb.
_FIRST_BIN = {14: 4681, 17: 585, 20: 73, 23: 9, 26: 1, 29: 0}


def smallest_bin(start: int, end: int) -> int:
    """Number of the smallest bin that holds the 0-based half-open range."""
    for shift, first in _FIRST_BIN.items():
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def read_index(path: str, ref: int) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """(bin -> chunks of virtual offsets, least virtual offset per window) of one contig of a .bai file."""
    with _open(path) as f:
        raw = f.read()
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{path} is no BAM index")
    at = 8
    for r in range(struct.unpack_from("<i", raw, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        n_bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", raw, at)
            if r == ref:
                flat = struct.unpack_from(f"<{2 * n}Q", raw, at + 8)
                bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * n
        n = struct.unpack_from("<i", raw, at)[0]
        if r == ref:
            return bins, list(struct.unpack_from(f"<{n}Q", raw, at + 4))
        at += 4 + 8 * n
    return {}, []


def region_chunks(bins: dict[int, list[tuple[int, int]]], windows: list[int], start: int, end: int, join: int = 1 << 16) -> list[tuple[int, int]]:
    """Stretches of virtual offsets that can hold reads on [start, end), in order; those within ``join`` compressed bytes become one."""
    least = windows[min(start >> 14, len(windows) - 1)] if windows else 0
    numbers = [first + k for shift, first in _FIRST_BIN.items() for k in range(start >> shift, ((end - 1) >> shift) + 1)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(c for n in numbers for c in bins.get(n, []) if c[1] > least):
        a = max(a, least)
        if out and (a >> 16) <= (out[-1][1] >> 16) + join:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def read_header(path: str) -> tuple[list[str], int]:
    """(contig names, uncompressed bytes of the header) of a BAM file."""
    with _open(path) as raw, gzip.GzipFile(fileobj=raw) as f:
        if f.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        (n,) = struct.unpack("<i", f.read(4))
        f.read(n)
        (k,) = struct.unpack("<i", f.read(4))
        names, size = [], 12 + n
        for _ in range(k):
            (m,) = struct.unpack("<i", f.read(4))
            names.append(f.read(m)[:-1].decode())
            f.read(4)
            size += 8 + m
    return names, size


def decode_record(data: bytes | memoryview, at: int, names: list[str]) -> tuple:
    """Fields of the alignment record whose length field is at ``at``, as a row of the read schema."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data, at + 4)
    p = at + 36
    name = bytes(data[p : p + l_name - 1]).decode("ascii", "replace")
    p += l_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, p)
    p += 4 * n_cigar
    packed = bytes(data[p : p + (l_seq + 1) // 2])
    p += (l_seq + 1) // 2
    seq = "".join(SEQ_CODES[b >> 4] + SEQ_CODES[b & 15] for b in packed)[:l_seq]
    qual = bytes(data[p : p + l_seq])
    text = "*" if not l_seq or qual[:1] == b"\xff" else bytes(min(q + 33, 126) for q in qual).decode()
    cigar = "".join(f"{c >> 4}{CIGAR_CODES[c & 15]}" for c in ops) or "*"
    return name, flag, names[ref] if 0 <= ref < len(names) else "*", pos + 1, mapq, cigar, seq or "*", text


def _plausible(data: bytes, at: int, n_refs: int) -> bool:
    if at + 36 > len(data):
        return False
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate = struct.unpack_from("<iiiBBHHHii", data, at)
    need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    return -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and l_name >= 1 and 0 <= l_seq < 1 << 28 and need <= size < 1 << 28 and (at + 35 + l_name >= len(data) or data[at + 35 + l_name] == 0)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Chunk(InputPartition):
    """A stretch of virtual offsets, and the region whose reads are wanted."""

    def __init__(self, path: str, begin: int, end: int, ref: int, start: int, stop: int) -> None:
        self.path, self.begin, self.end, self.ref, self.start, self.stop = path, begin, end, ref, start, stop


#: Rows of a batch that a task hands over.
ROWS = 4096
_ARROW = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("file", pa.string())])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


class BamReader(DataSourceReader):
    """``region``: (contig, first, last), 1-based and closed; files are then read through their index, whole if they have none."""

    def __init__(self, path: str, split: int, region: tuple[str, int, int] | None = None) -> None:
        self.path, self.split, self.region = path, split, region

    def partitions(self) -> list[InputPartition]:
        return [p for f in bam_files(self.path) for p in self._parts(f)]

    def _parts(self, path: str) -> list[InputPartition]:
        index = index_path(path) if self.region else None
        if index is None:
            size = _size(path)
            return [_Range(path, i, min(i + self.split, size)) for i in range(0, max(1, size), self.split)]
        names, _ = read_header(path)
        contig, first, last = self.region
        if contig not in names:
            return []
        ref = names.index(contig)
        bins, windows = read_index(index, ref)
        parts = []
        for a, b in region_chunks(bins, windows, max(0, first - 1), last):
            # a long stretch is cut where the windows' first reads lie
            cuts = [a]
            for w in windows:
                if cuts[-1] < w < b and (w >> 16) - (cuts[-1] >> 16) >= self.split:
                    cuts.append(w)
            parts += [_Chunk(path, x, y, ref, first - 1, last) for x, y in zip(cuts, [*cuts[1:], b], strict=True)]
        return parts

    def read(self, part: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing to read: Spark asks once all the same
            return iter(())
        rows = self._chunk(part) if isinstance(part, _Chunk) else self._range(part)
        if self.region:
            contig, first, last = self.region
            rows = (r for r in rows if r[2] == contig and r[3] <= last and r[3] + max(_span(r[5]), 1) > first)
        return _batches(rows)

    def _chunk(self, part: _Chunk) -> Iterator[tuple]:
        names, _ = read_header(part.path)
        with _open(part.path) as f:
            at = part.begin >> 16
            f.seek(at)
            raw, data, p = b"", bytearray(), part.begin & 0xFFFF
            starts: list[tuple[int, int]] = []  # (place in data, compressed offset) of each block

            def more() -> bool:
                nonlocal raw, at
                raw += f.read(1 << 17)
                used = 0
                for off, n in bgzf_blocks(raw):
                    starts.append((len(data), at + off))
                    data.extend(zlib.decompress(raw[off + 18 : off + n - 8], -15))
                    used = off + n
                raw, at = raw[used:], at + used
                return used > 0

            while True:
                while p + 4 > len(data) or p + 4 + struct.unpack_from("<i", data, p)[0] > len(data):
                    if not more():
                        return
                base, block = max((x for x in starts if x[0] <= p), key=lambda x: x[0])
                if (block << 16 | (p - base)) >= part.end:
                    return
                ref, pos = struct.unpack_from("<ii", data, p + 4)
                if ref != part.ref or pos >= part.stop:  # sorted by place: nothing of the region follows
                    return
                yield (*decode_record(data, p, names), part.path)
                p += 4 + struct.unpack_from("<i", data, p)[0]
                if base > 1 << 20:  # let go of what has been read
                    del data[:base]
                    p -= base
                    starts[:] = [(x - base, y) for x, y in starts if x >= base]

    def _range(self, part: _Range) -> Iterator[tuple]:
        names, header = read_header(part.path)
        size = _size(part.path)
        with _open(part.path) as f:
            at = part.start
            f.seek(at)
            window = f.read(min(size, part.end + (1 << 17)) - at)
            if at:  # the first true block: one that is followed by another, or by the end
                k = 0
                while True:
                    k = window.find(b"\x1f\x8b\x08\x04", k)
                    if k < 0 or at + k >= part.end:
                        return
                    chain = [b for _, b in zip(range(2), bgzf_blocks(window, k), strict=False)]
                    if len(chain) == 2 or (chain and at + k + chain[0][1] == size):
                        break
                    k += 1
                at += k
                window = window[k:]
            data, own, tail = bytearray(), 0, at
            blocks = list(bgzf_blocks(window))
            for off, n in blocks:
                if at + off >= part.end:
                    break
                data += zlib.decompress(window[off + 18 : off + n - 8], -15)
                tail = at + off + n
            own = len(data)
            f.seek(tail)
            rest = b""

            def more() -> bool:
                nonlocal rest
                rest += f.read(1 << 17)
                got = False
                used = 0
                for off, n in bgzf_blocks(rest):
                    data.extend(zlib.decompress(rest[off + 18 : off + n - 8], -15))
                    used, got = off + n, True
                rest = rest[used:]
                return got

            p = header if part.start == 0 else 0
            if part.start:  # the first record: a place from which several records in a row make sense
                while p < own:
                    q, ok = p, 0
                    while ok < 4 and _plausible(data, q, len(names)):
                        ok += 1
                        q += 4 + struct.unpack_from("<i", data, q)[0]
                        if q >= len(data) - 36:
                            break
                    if ok and (ok >= 4 or q >= len(data) - 36):
                        break
                    p += 1
            while p < own:
                while p + 4 > len(data) or p + 4 + struct.unpack_from("<i", data, p)[0] > len(data):
                    if not more():
                        return
                yield (*decode_record(data, p, names), part.path)
                p += 4 + struct.unpack_from("<i", data, p)[0]


def _span(cigar: str) -> int:
    return sum(int(n) for n, op in re.findall(r"(\d+)([MDN=X])", cigar))


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: a file, a folder or a glob of BAM files; options split, region (contig:first-last)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS + ", file string"

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split", SPLIT)), parse_region(self.options.get("region")))


def parse_region(text: str | None) -> tuple[str, int, int] | None:
    """contig, contig:first or contig:first-last, 1-based and closed; ValueError for anything else."""
    if not text:
        return None
    contig, sep, range_ = text.rpartition(":")
    if not sep:
        return text, 1, 1 << 29
    m = re.fullmatch(r"([\d,]+)(?:-([\d,]+))?", range_)
    if not m:
        raise ValueError(f"{text} is no region")
    first = int(m[1].replace(",", ""))
    last = int(m[2].replace(",", "")) if m[2] else 1 << 29
    if not 1 <= first <= last:
        raise ValueError(f"{text} is no region")
    return contig, first, min(last, 1 << 29)


def read_bam(spark: SparkSession, path: str, split: int = SPLIT, region: str | None = None) -> DataFrame:
    """Reads of BAM files, of one region only if it is given (overlapping reads count)."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("split", split).option("region", region or "").load(path)


def index_bam(path: str) -> str:
    """Write the index of a sorted local BAM file beside it (tests, small files); returns its path."""
    names, header = read_header(path)
    raw = open(path, "rb").read()
    data, starts = bytearray(), []
    for off, n in bgzf_blocks(raw):
        starts.append((len(data), off))
        data.extend(zlib.decompress(raw[off + 18 : off + n - 8], -15))

    def virtual(p: int) -> int:
        base, off = max((x for x in starts if x[0] <= p), key=lambda x: (x[0], -x[1]))
        return off << 16 | (p - base)

    bins: list[dict[int, list[list[int]]]] = [{} for _ in names]
    windows: list[dict[int, int]] = [{} for _ in names]
    p = header
    while p + 4 <= len(data):
        size = 4 + struct.unpack_from("<i", data, p)[0]
        ref, pos = struct.unpack_from("<ii", data, p + 4)
        if ref >= 0 and pos >= 0:
            end = pos + max(1, _span(decode_record(data, p, names)[5]))
            a, b = virtual(p), virtual(p + size)
            chunks = bins[ref].setdefault(smallest_bin(pos, end), [])
            if chunks and chunks[-1][1] == a:
                chunks[-1][1] = b
            else:
                chunks.append([a, b])
            for w in range(pos >> 14, ((end - 1) >> 14) + 1):
                windows[ref].setdefault(w, a)
        p += size
    out = bytearray(b"BAI\1" + struct.pack("<i", len(names)))
    for by_bin, by_window in zip(bins, windows, strict=True):
        out += struct.pack("<i", len(by_bin))
        for number, chunks in sorted(by_bin.items()):
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        n = max(by_window, default=-1) + 1
        out += struct.pack("<i", n)
        last = 0
        for w in range(n):
            last = by_window.get(w, last)
            out += struct.pack("<Q", last)
    with open(path + ".bai", "wb") as f:
        f.write(out)
    return path + ".bai"


def encode_bam(header: str, contigs: list[tuple[str, int]], rows: list[tuple]) -> bytes:
    """Uncompressed BAM bytes of rows of the read schema."""
    out = bytearray(b"BAM\1" + struct.pack("<i", len(header)) + header.encode() + struct.pack("<i", len(contigs)))
    for name, n in contigs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    place = {name: i for i, (name, _) in enumerate(contigs)}
    for qname, flag, rname, pos, mapq, cigar, seq, qual in rows:
        ops = [(int(n) << 4) | CIGAR_CODES.index(c) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        letters = "" if seq == "*" else seq
        codes = [SEQ_CODES.index(b) for b in letters] + [0] * (len(letters) % 2)
        body = struct.pack("<iiBBHHHiiii", place.get(rname, -1), pos - 1, len(qname) + 1, mapq, 0, len(ops), flag, len(letters), -1, -1, 0) + qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        body += bytes((a << 4) | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + (b"\xff" * len(letters) if qual == "*" else bytes(ord(c) - 33 for c in qual))
        out += struct.pack("<i", len(body)) + body
    return bytes(out)
