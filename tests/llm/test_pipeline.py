"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline as cp
from pyspark.sql import functions as F

from helixframe.llm.util import stored

from ..helpers import SF
from .test_operators import brute_repeats, odd_documents


def jaccard_groups(rows, k=5):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids, comp = sorted(sets), {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    a = stored(cp.quality_stage(spark, docs, SF), "a")
    assert a.columns == columns and 0 < a.count() < docs.count()
    b = stored(cp.near_duplicate_stage(spark, a, SF), "b")
    rows = [(r["doc_id"], r["text"]) for r in a.collect()]
    groups = jaccard_groups(rows)
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(set(groups.values())) and b.columns == columns
    c = stored(cp.passage_stage(spark, b, SF), "c")
    kept = [(r["doc_id"], r["text"]) for r in b.collect()]
    cut = {i: (n, gone) for i, n, gone, _, _ in brute_repeats(kept)}
    got = {r["doc_id"]: r["text"] for r in c.collect()}
    assert c.columns == columns and set(got) == {i for i, _ in kept}
    assert all(len(got[i].encode()) <= cut[i][0] - cut[i][1] and len(got[i].encode()) >= cut[i][0] - cut[i][1] - 6 * 3 * 50 for i in got)
    assert all(got[i] == t for i, t in kept if cut[i][1] == 0)
    d = stored(cp.mixing_stage(spark, c, SF), "d")
    assert d.columns == columns and d.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    e = cp.token_stage(spark, d, SF)
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    out = e.collect()
    assert len(out) == d.count() and all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in out)


def test_stages_take_odd_and_empty_tables(spark):
    d = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (d, d.limit(0)):
        for _, stage in cp.STAGES:
            docs = stored(stage(spark, docs, SF), "x")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
