"""Comparing a query with its SQL as the driver does: sorted columns, sorted rows."""

from __future__ import annotations

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sql: str, sf_dir: str = SF, frames: dict | None = None) -> list[dict]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, frame in (frames or {}).items():
        con.register(f"{name}_frame", frame)
        con.execute(f"create or replace view {name} as select * from {name}_frame")
    return con.execute(sql).to_arrow_table().to_pylist()


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(round(v, 6)) if type(v).__name__ == "Decimal" else v


def rows(data: list[dict]) -> list[tuple]:
    return sorted((tuple(_cell(r[k]) for k in sorted(r)) for r in data), key=lambda t: [(v is None, str(v)) for v in t])


def same(df, sql: str, sf_dir: str = SF, frames: dict | None = None) -> None:
    got, want = rows([r.asDict() for r in df.collect()]), rows(duck(sql, sf_dir, frames))
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b and not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-5) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:3]
