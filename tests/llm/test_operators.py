"""Edge cases of the corpus operators, and brute force where SQL can't express them."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import bpe, bytefeat, chat, embed, langid, minhash, mix, quality, suffix, topk, util, warc

from ..helpers import SF, same

DOCS = "doc_id long, text string"
WIDE = "extra int, doc_id long, text string, lang string, source string, n_chars long, size long, h long, cls long, copies string"


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    texts = [None, "", " \n\t", "x", "one two three", "one two three", "word " * 5000, "日本語 テキスト é", "1234 !!", "a b c d e f g h"]
    rows = [(i, i if i != 3 else None, t, ["en", None, "fr"][i % 3], ["s", None][i % 2], i, 1, 2, 3, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[9]], WIDE)


# ---------------------------------------------------------------- shared


def test_components_both_ways(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))], "a long, b long")
    assert dict(util.connected_components(df).collect()) == dict(util.connected_components(df, one_task=0).collect())
    assert util.connected_components(df.limit(0)).count() == 0


def test_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    d = odd_documents(spark)
    suffix.remove_repeats(d).count()
    minhash.near_duplicates(d).count()
    bpe.round_trip(d, bpe.Vocabulary.public()).count()
    assert spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), util.step(spark, 7):
        assert spark.conf.get(key) == "7"
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before


def test_scratch_tables_go(spark):
    with util.Scratch(spark) as tmp:
        a, b = tmp.stored(spark.range(5), "a"), tmp.stored(spark.range(3), "b")
        path = a.inputFiles()[0].rpartition("/")[0].removeprefix("file:").removeprefix("//")
        tmp.keep(b)
        assert os.path.isdir(path)
    assert not os.path.isdir(path) and b.count() == 3


def test_classes_that_share_a_key(spark, monkeypatch):
    """With keys of a few bits nearly all classes share theirs; the second digest tells them apart."""
    rows = [(i, t) for i, t in enumerate(["a b c d e f", "a b c d e f", "u v w x y z", "", None, *[" ".join(f"{w}{j}" for j in range(40 - i)) for w in "pqr" for i in (0, 0, 1, 2)]])]
    docs = spark.createDataFrame(rows, DOCS)
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, 0.1 * (i % 2)]) for i in range(30)], "vec_id long, embedding array<float>")
    take = lambda: (sorted(minhash.near_duplicates(docs, k=4).collect()), sorted(embed.near_vectors(vectors).collect()))
    want, key = take(), minhash._set_key
    monkeypatch.setattr(minhash, "_set_key", lambda x: (key(x)[0] % 2, key(x)[1]))
    monkeypatch.setattr(embed, "_class_key", lambda v: F.xxhash64(v) % 3)
    assert take() == want and util.shared_keys(spark.range(9).select((F.col("id") % 5).alias("cls"))).count() == 4
    assert util.shared_keys(spark.range(9).withColumnRenamed("id", "cls")) is None


def test_words_and_shingles():
    import pyarrow as pa

    data, off, null = bytefeat.text_buffers(pa.array(["a  b\tc", None, "", "é x", "c"]))
    s, e, row = bytefeat.words(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)] == ["a", "b", "c", "é", "x", "c"] and row.tolist() == [0, 0, 0, 3, 3, 4]
    h = bytefeat.span_hashes(data, s, e)
    assert h[2] == h[5] and len(set(h.tolist())) == 5 and null.tolist() == [False, True, False, False, False]
    sh, r = bytefeat.shingle_hashes(h, row, 5, 2)
    assert np.bincount(r, minlength=5).tolist() == [2, 0, 0, 1, 1]


# ---------------------------------------------------------------- 1


def pages(spark):
    rows = [(1, None, "x" * 3000), (2, "u\nv", "x" * 3000), (3, "u", None), (None, None, "x" * 3000), (5, "a\\nb", "é" * 90000), (5, "k", "é" * 90000), (6, "k", ""), (7, "k", "z" * 999), (8, "k", "z" * 999)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    warc.write_warc(pages(spark), str(tmp_path / "w"), segment=1000, chunk=333)
    raw = warc.read_warc(spark, str(tmp_path / "w"))
    assert raw.where("warc_type = 'continuation'").count() > 100
    got = warc.resolve(warc.payloads(raw)).collect()
    assert len(got) == 9 and all(r["whole"] for r in got)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert {(1, "revisit", 2, 3000), (None, "revisit", 2, 3000), (2, "response", None, 3000), (3, "response", None, 0), (7, "response", None, 999), (5, "response", None, 180000)} <= kinds
    lost = warc.payloads(raw.where("segment_number is null or segment_number <> 3"))
    assert lost.where("not whole").count() > 0
    warc.write_warc(pages(spark).limit(0), str(tmp_path / "e"))
    assert warc.resolve(warc.payloads(warc.read_warc(spark, str(tmp_path / "e")))).count() == 0


def test_warc_extra_columns_and_long_pages(spark, tmp_path):
    extra = pages(spark).select("*", F.lit("x").alias("digest"), F.lit(3).alias("top"), F.lit("y").alias("payload"), F.lit(1).alias("row"), F.lit(2).alias("d2"))
    long = spark.createDataFrame([(9, "u", "ab\r\n" * 700_000)], "page_id long, url string, html string")
    warc.write_warc(extra.unionByName(long, allowMissingColumns=True), str(tmp_path / "w"))
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.resolve(warc.payloads(warc.read_warc(spark, str(tmp_path / "w")))).collect()}
    assert len(got) == 9 and all(r["whole"] for r in got.values()) and got[9, 2_800_000]["payload_digest"] == hashlib.sha1(b"ab\r\n" * 700_000).hexdigest()


def test_streamed_archives(spark, tmp_path):
    rng = random.Random(3)
    blocks = [b"", b"plain", b"a WARC/1.1\r\nin the middle WARC/1. of it", bytes(rng.randrange(256) for _ in range(200_000)), "é".encode() * 50, b"WARC/1.0\r\n\r\n"]
    records = [[("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>"), ("WARC-Target-URI", f"u/WARC/1.{i}")] for i in range(len(blocks))]
    members = [warc._record(h, b) for h, b in zip(records, blocks, strict=True)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "y.warc").write_bytes(b"".join(zlib.decompress(m, 31) for m in members))
    for name in ("x.warc.gz", "y.warc"):
        got = {r["record_id"]: r for r in warc.stream_warc(spark, str(tmp_path / name)).collect()}
        assert [bytes(got[f"<{i}>"]["block"]) for i in range(len(blocks))] == blocks and len(got) == len(blocks)
        assert all(r["intact"] and r["warc_type"] == "resource" for r in got.values()) and got["<2>"]["target_uri"] == "u/WARC/1.2"
    whole = {(r["record_id"], r["intact"]) for r in warc.read_warc(spark, str(tmp_path / "x.warc.gz")).collect()}
    assert whole == {(f"<{i}>", True) for i in range(len(blocks))}


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(body, size):
    assert warc.chunk_decode(warc.chunk_encode(body, size)) == (body, True)
    assert not warc.chunk_decode(warc.chunk_encode(body, size)[:-1])[1]


# ---------------------------------------------------------------- 2 and 4

VECTORS = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, []), (None, [1.0, 2.0]), (6, [2.0, 4.0]), (40, [1.0, 2.0, 3.0]), (7, [float("inf"), 1.0])]


def test_topk_edges(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, k=2).collect()]
    assert sorted(got) == [(20, 1, 6, 40960), (20, 2, 40, 20480), (40, 1, 6, 40960), (40, 2, 20, 20480)]
    assert topk.top_k(df.limit(0)).count() == 0


def clashing(df, *names):
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def test_vectors_extra_columns(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    names = ("v", "key", "vec", "cls", "segment", "cell", "side", "score", "rank", "query_id", "weight", "strip", "least", "ok", "check")
    rows = lambda d: sorted(d.collect(), key=str)
    assert rows(topk.top_k(clashing(df, *names), k=2)) == rows(topk.top_k(df, k=2))
    assert rows(embed.near_vectors(clashing(df, *names))) == rows(embed.near_vectors(df))


def test_topk_large_components(spark):
    df = spark.createDataFrame([(i, [float(i) * 1e8, 1.0]) for i in range(0, 60, 3)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, k=2).collect()]
    q = {i: (64 * i * 10**8, 64) for i in range(0, 60, 3)}
    score = lambda a, b: q[a][0] * q[b][0] + q[a][1] * q[b][1]
    assert sorted(got) == [(0, 1, 3, 4096), (0, 2, 6, 4096)]
    assert score(0, 3) == 4096


@pytest.mark.parametrize("segment,group", [(2048, 24), (256, 2)])
def test_topk_ties_and_blocks(spark, monkeypatch, segment, group):
    monkeypatch.setattr(topk, "SEGMENT", segment)
    monkeypatch.setattr(topk, "CELL_SEGMENTS", group)
    monkeypatch.setattr(topk, "CELL_QUERIES", 4)
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((3000, 8)) / 4, 1).astype(np.float32)
    x[500:1500] = x[500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = np.floor(64 * x.astype(np.float64)).astype(int)
    got = {}
    for r in topk.top_k(df, k=20, every=250).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 3000, 250):
        s = q @ q[i]
        ids = np.flatnonzero(np.arange(3000) != i)
        best = ids[np.lexsort((ids, -s[ids]))[:20]]
        assert [(v, c) for _, v, c in sorted(got[i])] == [(int(b), int(s[b])) for b in best]


def test_embed_edges(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed.near_vectors(df).collect()}
    assert got == {(20, 3, 6, False), (6, 3, 6, True), (None, 3, 6, False), *[(i, 0, i, True) for i in (1, 2, 3, 4, 5, 7, 40)]}
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_embed_chunks_count_each_link_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base[rng.integers(0, 40, 500)] + rng.standard_normal((500, 16)) * s for s in (0.05, 0.25)])
    monkeypatch.setattr(embed, "CHUNK", 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embed.near_vectors(df).collect()}
    assert [got[i] for i in range(1000)] == want.tolist()


# ---------------------------------------------------------------- 3

TEXTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "s>", "/s>", "a", " ", "é", "\n"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<s>\\", "x\n"]), TEXTS), max_size=6))
def test_template_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def replay(events):
    """A naive reading of a log, event by event over the whole of a conversation: the texts that are left, in order of their start."""
    state, done = {}, {}
    for conv, seq, event, message, payload in sorted(set(events), key=lambda e: (e[0] or 0, e[1], e[2], e[4] or "")):
        key = (conv, message)
        if event == "start":
            state[key] = [seq, payload or "", ""]
        elif key in state:
            if event == "delta":
                state[key][2] += payload or ""
            elif event == "edit":
                state[key][2] = payload or ""
            elif event == "regenerate":
                state[key][2] = ""
            else:
                del state[key]
    for (conv, message), (seq, role, text) in state.items():
        done.setdefault(conv, []).append((seq, message, role, text))
    return {c: [x[2:] for x in sorted(v)] for c, v in done.items()}


def test_log_of_interleaved_messages(spark):
    rng = random.Random(3)
    events = []
    for conv in (1, 2, None):
        seq = 0
        for _ in range(400):
            m = f"m{rng.randrange(12)}"
            seq += 1
            event = rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "retract"])
            events.append((conv, seq, event, m, rng.choice(["user", "assistant"]) if event == "start" else rng.choice([f"t{seq} ", "</s>", "", None])))
    want = replay(events)
    events += events[::7]  # delivered twice
    rng.shuffle(events)
    log = spark.createDataFrame([(c, s, e, m, p, "x") for c, s, e, m, p in events], "conv_id long, seq long, event string, message string, payload string, place string")
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(log).collect()}
    assert got == want and all(len(v) > 3 for v in want.values())
    with pytest.raises(ValueError):
        chat.Message().apply("what", "")
    assert chat.format_conversations(log.limit(0)).count() == 0


def test_made_log_is_interleaved_and_ends_in_the_rows(spark):
    df = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], f"text {c} {t} " * (1 + t * 40)) for c in range(4) for t in range(30)], "conv_id long, turn long, role string, text string")
    log = chat.conversation_events(df).collect()
    assert {r["event"] for r in log} == {"start", "delta", "edit", "regenerate"}
    order = [r["message"] for r in sorted(log, key=lambda r: (r["conv_id"], r["seq"])) if r["conv_id"] == 0]
    runs = [m for i, m in enumerate(order) if i == 0 or order[i - 1] != m]
    assert len(runs) > len(set(runs))  # some messages go on after others began
    want = replay([(r["conv_id"], r["seq"], r["event"], r["message"], r["payload"]) for r in log])
    assert want == {c: [(r["role"], r["text"]) for r in df.where(f"conv_id = {c}").orderBy("turn").collect()] for c in range(4)}
    assert {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(chat.conversation_events(df)).collect()} == want


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", ""), (2, 3, "assistant", "x" * 500_000), (2, 1, "tool", "</s>\\[ROLE")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "seq", "event", "payload", "message", "n", "at", "kind", "i", "e", "place")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.conversation_events(df))).collect()}
    assert (got[1]["n_turns"], got[2]["n_turns"], got[2]["loss_chars"], got[None]["loss_chars"]) == (3, 2, 500_000, 0)
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\n\n\n").hexdigest()
    assert chat.format_conversations(chat.conversation_events(df.limit(0))).count() == 0


# ---------------------------------------------------------------- 5


def test_mix_edges(spark):
    m = mix.mix_sources(odd_documents(spark)).collect()
    assert len(m) == 12 and all(r["taken"] <= 3 * r["size"] for r in m)
    assert mix.mix_sources(odd_documents(spark).limit(0)).count() == 0
    d = odd_documents(spark)
    assert mix.mix_documents(d).columns == d.columns


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("e", 0)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mix.source_targets(sizes).collect()}
    assert t["a"] == 30 and t["e"] == 0 and t[None] == 15 and abs(sum(t.values()) - 2015) < 1e-6 and abs(t["b"] / t["c"] - 2) < 1e-9


def test_nested_budgets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 2}") for i in range(2000)], "doc_id long, text string, source string")
    sized = docs.select("doc_id", "source", mix.word_count(F.col("text")).alias("size"), mix.doc_hash(F.col("doc_id")).alias("h"))
    budgets = spark.createDataFrame([("s0", 100.0, 2000.0), ("s1", 100.0, 2000.0)], "source string, lo double, hi double")
    t = mix.hash_thresholds(sized, budgets, ("lo", "hi"))
    got = sized.join(t, "source").where("h <= threshold").groupBy("source", "name").agg(F.sum("size").alias("n")).collect()
    assert all(abs(r["n"] - {"lo": 100, "hi": 2000}[r["name"]]) <= 4 for r in got) and len(got) == 4


# ---------------------------------------------------------------- 6


def brute_repeats(rows, width=50):
    own, out = {}, []
    data = [(i if i is not None else 2**63 - 1, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - width + 1):
            own[b[p : p + width]] = min(i, own.get(b[p : p + width], i))
    for i, b in data:
        c = np.zeros(len(b) + 2, np.int8)
        for p in range(len(b) - width + 1):
            if own[b[p : p + width]] < i:
                c[p + 1 : p + 1 + width] = 1
        keep = bytes(x for x, z in zip(b, c[1:-1], strict=True) if not z)
        out.append((i, len(b), int(c.sum()), int((np.diff(c) == 1).sum()), hashlib.sha256(keep).hexdigest()))
    return sorted(out)


def repeats(df):
    r = suffix.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("s"))
    return sorted((x[0] if x[0] is not None else 2**63 - 1, *x[1:]) for x in r.collect())


@pytest.mark.parametrize("pack,bucket", [(2 << 20, 8 << 20), (2000, 3000)])
def test_repeats_against_brute_force(spark, monkeypatch, pack, bucket):
    monkeypatch.setattr(suffix, "PACK_BYTES", pack)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket)
    rng = random.Random(0)
    base = "".join(rng.choice("abcde é\n") for _ in range(400))
    noise = lambda: "".join(rng.choice("xyz ") for _ in range(rng.randrange(60)))
    rows = [(rng.choice([i, i, None, 5]), noise() + base[(a := rng.randrange(300)) : a + rng.randrange(150)] + noise()) for i in range(100)]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "a" * 300), (203, "a" * 300), (204, "ab" * 100), (205, "ab" * 100)]
    assert repeats(spark.createDataFrame(rows, DOCS)) == brute_repeats(rows)


def test_repeats_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select(*DOCS.replace(" long", "").replace(" string", "").split(", "))
    assert repeats(df) == brute_repeats([tuple(r) for r in df.collect()])
    d = odd_documents(spark)
    out = suffix.remove_repeats(d, as_text=True)
    assert out.columns[: len(d.columns)] == d.columns and out.count() == 12
    assert suffix.remove_repeats(d.limit(0)).count() == 0


def test_repeats_in_long_texts(spark):
    rng = random.Random(8)
    a = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, a[:40_000]), (2, a), (3, "x" * 100 + a[2_000_000:2_000_300] + "y" * 30)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (0, 0) and got[2] == (40_000, 1) and got[3][0] >= 300 and got[3][0] <= 302


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lens = rng.integers(1, 15, rng.integers(1, 12))
        data = rng.integers(0, 3, lens.sum()).astype(np.uint8)
        strings = [bytes(x) for x in np.split(data, np.cumsum(lens)[:-1])]
        order = sorted(s[k:] for s in strings for k in range(len(s) + 1))
        shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(order[:-1], order[1:], strict=True)]
        assert suffix.suffix_order(data, lens)[1].tolist() == shared


# ---------------------------------------------------------------- 7 and 10


def test_held_out(spark):
    df = spark.range(50).select("id", langid.held_out(F.col("id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in df.collect())


def test_codewords():
    for k in (2, 3, 4, 5, 9, 20):
        c = langid.codewords(k)
        d = (c.shape[1] - c @ c.T) / 2 + np.eye(k) * 99
        assert d.min() >= 1 and (np.abs(c.sum(0)) < k).all()


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = langid.op7_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def grams_of(text: str, orders) -> list[bytes]:
    """Byte grams inside words, the spaces beside a word among its bytes; one place at a time."""
    buf = b" " + bytes(32 if b in b" \t\n\v\f\r" else b for b in text.encode()) + b" "
    out = []
    for n in orders:
        for i in range(len(buf) - n + 1):
            g = buf[i : i + n]
            if g.strip(b" ") and b" " not in g[1:-1] and not (n == 1 and g == b" "):
                out.append(g)
    return out


def bucket_of(gram: bytes, bits: int) -> int:
    h = (2166136261 + len(gram) * 97) & 0xFFFFFFFF
    for b in gram:
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return ((h * 2654435761) & 0xFFFFFFFF) >> (32 - bits)


ODD_TEXTS = ["", " \n", "x", "a bc  def\tghij", "Été Hello hello", "日本語 ab", "aa aa b b b", "z" * 300]


def buffers(texts):
    import pyarrow as pa

    return bytefeat.text_buffers(pa.array(texts))[:2]


def test_language_features_and_decoding_one_by_one():
    got = langid.features(*buffers(ODD_TEXTS))
    want = np.zeros_like(got)
    for i, t in enumerate(ODD_TEXTS):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        for g in grams_of(low, langid.ORDERS):
            want[i, bucket_of(g, langid.BITS)] += 1
        want[i] = np.sqrt(want[i]) / max(np.sqrt(want[i].sum()), 1e-9)
    assert np.abs(got - want).max() < 1e-5
    rng = np.random.default_rng(0)
    k = 7
    code = langid.codewords(k)
    n = code.shape[1]
    trust = rng.random((k, n)).astype(np.float32)
    trust /= trust.sum(1, keepdims=True)
    m = langid.Model([str(i) for i in range(k)], code, rng.standard_normal((want.shape[1], n)).astype(np.float32), rng.standard_normal(n).astype(np.float32), trust)
    best, score, vague = m.predict(got)
    for i, x in enumerate(got):
        f = [float(x @ m.weight[:, b] + m.bias[b]) for b in range(n)]
        loss = [sum(trust[c, b] * np.log1p(np.exp(-code[c, b] * f[b])) for b in range(n)) for c in range(k)]
        p = np.exp([-4 * (v - min(loss)) for v in loss])
        p = np.sort(p / p.sum())[::-1]
        assert best[i] == int(np.argmin(loss)) and abs(score[i] - p[0]) < 1e-4 and bool(vague[i]) == bool(p[0] - p[1] < 0.2)


def test_language_fit_is_a_gradient_descent():
    rng = np.random.default_rng(1)
    x, y = rng.random((30, 12)).astype(np.float32), rng.integers(0, 3, 30)
    m = langid.fit(x, y, ["a", "b", "c"], rounds=5, rate=2.0, decay=0.01)
    code = langid.codewords(3)
    w, b = np.zeros((12, code.shape[1])), np.zeros(code.shape[1])
    share = np.array([1 / (y == i).sum() for i in y])
    share /= share.sum()
    for _ in range(5):
        gw, gb = 0.01 * w, np.zeros_like(b)
        for i in range(30):
            for j in range(code.shape[1]):
                t = code[y[i], j]
                g = -t * share[i] / (1 + np.exp(t * (x[i] @ w[:, j] + b[j])))
                gw[:, j] += g * x[i]
                gb[j] += g
        w, b = w - 2.0 * gw, b - 0.2 * gb
    assert np.abs(m.weight - w).max() < 1e-4 and np.abs(m.bias - b).max() < 1e-4


def test_language_rows_one_by_one(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.learn(d)
    got = {r["doc_id"]: r for r in langid.identify(d, m).collect()}
    for r in d.collect():
        g = got[r["doc_id"]]
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (g["lang_pred"], g["score"]) == ("und", 0)
        else:
            k, score, vague = m.predict(langid.features(*buffers([r["text"]])))
            assert g["lang_pred"] == m.langs[k[0]] and abs(g["score"] - score[0]) < 1e-5
    few = langid.learn(d, max_langs=2)
    top = [r["lang"] for r in d.where(~langid.held_out(F.col("doc_id")) & F.col("text").isNotNull()).groupBy("lang").count().where("lang is not null").orderBy(F.col("count").desc(), "lang").limit(2).collect()]
    assert few.langs == sorted(top)


def words_of(text):
    return "".join(c if c not in "\t\n\v\f\r" else " " for c in text).split(" ")


@pytest.mark.parametrize("repeats", [False, True])
def test_quality_counts_and_scores_one_by_one(repeats):
    data, offsets = buffers(ODD_TEXTS)
    rng = np.random.default_rng(2)
    m = quality.Model(rng.standard_normal(1 << quality.BITS).astype(np.float32), 0.3, repeats)
    z = m.logits(data, offsets)
    for i, (t, (ids, n)) in enumerate(zip(ODD_TEXTS, quality.counts(data, offsets, repeats), strict=True)):
        want: dict[int, int] = {}
        w = [x for x in words_of(t) if x]
        for x in w:
            raw = np.frombuffer(x.encode(), np.uint8)
            b = int(bytefeat.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0] >> np.uint64(64 - quality.BITS))
            want[b] = want.get(b, 0) + 1
        if repeats:
            for x, y in zip(w[:-1], w[1:], strict=True):
                if x == y:
                    want[quality.REPEAT] = want.get(quality.REPEAT, 0) + 1
        for g in grams_of(t, quality.ORDERS):
            b = bucket_of(g, quality.BITS)
            want[b] = want.get(b, 0) + 1
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == want
        assert abs(z[i] - (sum(m.table[b] * c for b, c in want.items()) / max(sum(want.values()), 1) + 0.3)) < 1e-4


def test_quality_fit_is_a_gradient_descent():
    rng = np.random.default_rng(5)
    docs = [(np.sort(rng.choice(50, 6, replace=False)).astype(np.uint16), rng.integers(1, 4, 6).astype(np.uint32)) for _ in range(8)]
    y, weight = np.array([0, 1] * 4), rng.random(8).astype(np.float32)
    m = quality.fit(docs, y, weight, epochs=2, batch=4, rate=0.5, seed=1)
    r = np.random.default_rng(1)
    emb = r.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32).astype(float)
    out, bias, step = r.uniform(-1, 1, (quality.DIM, 2)).astype(np.float32).astype(float), np.zeros(2), 0
    for _ in range(2):
        order = r.permutation(8)
        for i in range(0, 8, 4):
            ge, go, gb = np.zeros_like(emb), np.zeros_like(out), np.zeros(2)
            for k in order[i : i + 4]:
                share = docs[k][1] / docs[k][1].sum()
                h = sum(s * emb[b] for b, s in zip(docs[k][0], share, strict=True))
                p = np.exp(h @ out + bias)
                g = (p / p.sum() - np.eye(2)[y[k]]) * weight[k] / 4
                for b, s in zip(docs[k][0], share, strict=True):
                    ge[b] += s * (out @ g)
                go += np.outer(h, g)
                gb += g
            lr = 0.5 * (1 - step / 4)
            step += 1
            emb, out, bias = emb - 50 * lr * ge, out - lr * go, bias - lr * gb
    assert np.abs(m.table - emb @ (out[:, 1] - out[:, 0])).max() < 1e-4 and abs(m.bias - (bias[1] - bias[0])) < 1e-5


def test_quality_of_repeated_ids_and_labels(spark):
    d = spark.createDataFrame([(i % 4, f"text {i % 4} {'good words here' if i % 2 else 'zz zz zz'}") for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i % 4, i % 2) for i in range(400)], "doc_id long, quality int")
    got = quality.score(d, quality.learn(d, labels, repeats=True)).collect()
    assert len(got) == 40 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    d = odd_documents(spark)
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(d, langid.learn(d)).collect()}
    assert (0, "und") in got and (1, "und") in got and (8, "und") in got and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.learn(d.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(d, None).collect()} == {"und"}


def test_quality_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95


def test_quality_edges(spark):
    d = odd_documents(spark)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(d, quality.learn(d, none)).collect()} == {0.5}
    one = quality.learn(d, spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int"))
    assert all(r["predicted"] == 1 for r in quality.score(d, one).collect())
    assert quality.score(d.limit(0), one).count() == 0


# ---------------------------------------------------------------- 8


def test_near_duplicates_edges(spark):
    rows = [(1, "A b c d e f"), (2, "a B c d e f"), (None, "a b c d e f"), (3, None), (4, ""), (5, " \n"), (6, "x"), (6, "x"), (7, "x y"), (8, "x y ")]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), k=4).collect())
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (-1, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False)])
    d = odd_documents(spark)
    assert minhash.near_duplicates(d).count() == 12 and minhash.near_duplicates(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(d, numerator=70)


def test_near_copies_with_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    rows = [(1, text()), (None, text(30)), (None, text(30, 31)), (5, text(30, 31, 32)), (9, "other " + text(5)), (None, "a b c d e f"), (None, "a b c d e f g")]
    rows += [(None, " ".join(f"q{i}" for i in range(50))), (None, " ".join(f"q{i}" for i in range(1, 50)))]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), k=4).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (None, 1, False), (None, 1, False), (5, 1, False), (9, 1, False), *[(None, None, True)] * 4], key=str)


def test_dense_families(spark, monkeypatch):
    """Families of copies at all distances, so large that nodes branch and dense ones are tiled."""
    monkeypatch.setattr(minhash, "NODE_LIMIT", 8)
    monkeypatch.setattr(minhash, "DENSE_CHUNK", 16)
    rng = random.Random(4)
    docs = []
    for f in range(4):
        base = [f"w{f}_{i}" for i in range(60)]
        for _ in range(60):
            t = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                t[rng.randrange(60)] = f"n{rng.random()}"
            docs.append(" ".join(t))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (d.split() for d in docs)]
    comp = list(range(len(docs)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), DOCS), k=4).collect()}
    assert [got[i] for i in range(len(docs))] == [find(i) for i in range(len(docs))]


# ---------------------------------------------------------------- 9


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return bpe.Codec(bpe.Vocabulary.public()), tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab é日\n0", max_size=400)), max_size=5))
def test_bpe_like_the_library(codec, texts):
    mine, lib = codec
    ids = mine.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [lib.encode_ordinary(t) for t in texts]
    assert mine.decode(ids) == [t.encode() for t in texts]


def test_bpe_long_words_and_cache(codec, monkeypatch):
    mine, lib = codec
    rng = random.Random(1)
    texts = ["a" * 3000, "ing" * 300, " " * 700, "".join(rng.choice("abcdefgh0") for _ in range(2000)), "<|endoftext|> I'll  go\x1c\x85y", "日本語" * 100]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    assert [np.frombuffer(i, "<u4").tolist() for i in mine.encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_bpe_very_long_words(codec):
    mine, lib = codec
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120_000)), "a" * 400_001, "xyz" * 50_000 + "q", "é" * 5000, "".join(rng.choice("ab") for _ in range(20_000))]
    ids = mine.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [lib.encode_ordinary(t) for t in texts]
    assert mine.decode(ids) == [t.encode() for t in texts]
    for t in texts:  # from left to right, as for words whose windows don't meet
        assert mine._scan(t[:9000].encode()).tolist() == lib.encode_ordinary(t[:9000])


def test_bpe_any_order_of_rows(codec):
    mine, lib = codec
    words = [b"hello", b"unbelievable", b"internationalisation", b"aaaaaaa", b"strawberries"]
    rows = mine._rows(words)
    order = np.random.default_rng(0).permutation(rows.num_rows)
    mine.db.register("bytes_", rows.take(order))
    got = mine.db.sql(bpe.ENCODE_SQL).to_arrow_table()
    ids = got.column("id").to_numpy()
    edge = np.searchsorted(got.column("word").to_numpy(), np.arange(len(words) + 1))
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [lib.encode_ordinary(w.decode()) for w in words]


def test_bpe_ranks_that_no_training_gives(tmp_path):
    """Ranks at random, so that merges make pairs of lower rank: one least pair at a time, leftmost first, is still what comes out."""
    rng = random.Random(7)
    pool = {bytes([i]) for i in range(256)}
    while len(pool) < 420:
        pool.add(bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))))
    tokens = sorted(pool, key=lambda t: (len(t) > 1, rng.random()))
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    mine = bpe.Codec(bpe.Vocabulary.load(str(tmp_path / "r"), r"\S+|\s+"))
    ranks = {t: i for i, t in enumerate(tokens)}

    def naive(data: bytes) -> list[int]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (5, 60, 200, 300, 700, 1500)]
    assert [np.frombuffer(i, "<u4").tolist() for i in mine.encode(texts)] == [[ranks[t.encode()]] if t.encode() in ranks else naive(t.encode()) for t in texts]


def test_bpe_edges(spark, codec):
    got = {r["doc_id"]: r for r in bpe.round_trip(odd_documents(spark), bpe.Vocabulary.public()).collect()}
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 0 and got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[6]["decoded_sha256"] == hashlib.sha256(("word " * 5000).encode()).hexdigest()
    assert bpe.round_trip(odd_documents(spark).limit(0), bpe.Vocabulary.public()).count() == 0


def test_same_helper(spark):
    same(spark.range(3), "select * from range(3) t(id)")


def test_very_long_texts(spark):
    """A text of 4 MB beside short ones in the operators that take whole texts."""
    rng = random.Random(11)
    words = [f"{rng.choice(['the', 'house', 'river', 'and', 'stone'])}{rng.randrange(5000)}" for _ in range(450_000)]
    long, near = " ".join(words), " ".join(words[:-3000])
    d = spark.createDataFrame([(2, long, "en"), (5, near, "en"), (6, "a short text of a few words", "en"), (8, "noch ein kurzer Text mit Worten", "de"), (9, "", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(d, k=4).collect()}
    assert got[5][0] == got[2][0] == 2 and got[2][1] > 400_000 and got[6][0] == 6
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(d, langid.learn(d)).collect()}[9] == "und"
    model = quality.learn(d, spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(d, model).collect())
    back = {r["doc_id"]: r for r in bpe.round_trip(d, bpe.Vocabulary.public()).collect()}
    assert back[2]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def plain_fragments(data: bytes, offsets: list[int], width: int) -> list[tuple]:
    """(row, start, windows, offset of the anchor) by looking at every window."""
    grams = [suffix._gram_hash(*(np.frombuffer(data[i + d : i + d + 8], "<u8").copy() for d in (0, suffix.GRAM - 8)))[0] >> np.uint64(36) for i in range(len(data) - suffix.GRAM + 1)]
    out = []
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        last = None
        for s in range(a, b - width + 1):
            p = min(range(s, s + width - suffix.GRAM + 1), key=lambda i: (grams[i], i))
            if p == last:
                out[-1][2] += 1
            else:
                out.append([row, s, 1, p - s])
            last = p
    return [tuple(x) for x in out]


@pytest.mark.parametrize("stretch", [1, 7, 64, 16_384])
def test_fragments_across_stretches(monkeypatch, stretch):
    monkeypatch.setattr(suffix, "STRETCH", stretch)
    rng = np.random.default_rng(4)
    sizes = [0, 49, 50, 51, 300, 0, 120, 64, 10, 500]
    data = rng.integers(97, 99, sum(sizes)).astype(np.uint8)
    data[200:290] = 97  # grams that are equal
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    digest, row, start, windows, inset = suffix.fragments(data, offsets)
    assert list(zip(row.tolist(), start.tolist(), windows.tolist(), inset.tolist(), strict=True)) == plain_fragments(data.tobytes(), offsets.tolist(), 50)
    assert digest.tolist() == suffix.anchor_digests(data, start + inset).tolist()


def test_fragments_need_little_memory():
    data = np.random.default_rng(5).integers(97, 123, suffix.PACK_BYTES).astype(np.uint8)
    tracemalloc.start()
    suffix.fragments(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(data)  # whole-pack arrays of hashes took over 40 bytes for each of text


def test_cover_of_windows_by_brute_force():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab"), n)) for n in (200, 49, 0, 180, 260)]
    texts[3] = texts[0][20:120] + texts[3][:80]
    texts[4] = texts[3][30:150] + texts[0][:100]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 1, 2, 3, 4]), pa.array(texts)], ["doc_id", "text"])
    pack = suffix.Pack(batch, "doc_id", "text", 50)
    parts = pack.repeated(2, {k: np.ones(len(u), np.uint8) for k, u, _ in pack.anchors(2)})
    owners = {k: suffix.owners_of_bucket([pack.blob(v)], 50)[0] for k, v in parts.items()}
    cover = suffix._cover(pack, parts, owners, 50)
    ids, want = [5, 1, 2, 3, 4], []
    for i, t in enumerate(texts):
        gone = [any(t[s : s + 50] in u for j, u in enumerate(texts) if ids[j] < ids[i]) for s in range(max(len(t) - 49, 0))]
        want += [any(gone[max(0, x - 49) : x + 1]) for x in range(len(t))]
    assert cover.tolist() == want


def test_decoding_groups_nothing():
    codec = bpe.Codec(bpe.Vocabulary.public())
    texts = ["one two \u00e9\u4e2d", "", " three", "\x00\U0001f600"]
    ids = codec.encode(texts)
    assert codec.decode([*ids, b"", np.array([2**31 - 1, 65535], "<u4").tobytes()]) == [*[t.encode() for t in texts], b"", b""]
    assert codec.decode([np.array([65535], "<u4").tobytes()]) == [b""]
    plan = codec.db.execute("explain " + bpe.DECODE_SQL).fetchall()[0][1].lower()
    assert "group" not in plan and "aggregate" not in plan
