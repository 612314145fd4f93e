"""Views that let the relational test tables stand for sequencing tables.

lineitem is the read evidence, part the reference with its structure, nation
the annotation, orders and lineitem together the reads. The same SQL text runs
in Spark and in DuckDB.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_PILEUP = """
  select concat('chr', cast(l_suppkey % 3 as string)) as chr,
         case when l_linestatus = 'O' then '+' else '-' end as strand, cast(l_partkey as int) as pos{extra},
         cast(sum(case when l_discount >= 0.07 then 1 else 0 end) as bigint) as mut_count,
         cast(sum(case when l_tax >= 0.06 then 1 else 0 end) as bigint) as stop_count,
         cast(sum(cast(l_quantity as bigint)) as bigint) as depth
  from lineitem {where} group by 1, 2, 3{group}
"""

CTE = {
    "pileup_mod_": _PILEUP.format(extra="", where="where l_linenumber % 2 = 1", group=""),
    "pileup_unmod_": _PILEUP.format(extra="", where="where l_linenumber % 2 = 0", group=""),
    "pileup_cell_": _PILEUP.format(extra=", concat('RHX', cast(l_linenumber as string)) as cell", where="", group=", 4"),
    "items_": """select concat('chr', cast(l_suppkey % 3 as string)) as chr, case when l_linestatus = 'O' then '+' else '-' end as strand, cast(l_partkey as int) as pos, concat('RHX', cast(l_linenumber as string)) as cell,
        cast(l_linenumber % 2 as int) as is_mod, cast(case when l_discount >= 0.07 then 1 else 0 end as bigint) as mut_count, cast(case when l_tax >= 0.06 then 1 else 0 end as bigint) as stop_count, cast(l_quantity as bigint) as depth from lineitem""",
    "structure_": "select cast(p_partkey as int) as pos, substring('ACGU', cast(p_size % 4 as int) + 1, 1) as base, p_size > 25 as is_single from part",
    "genes_": """select concat('chr', cast(n_regionkey % 3 as string)) as seqname, cast(1 + n_nationkey * 80 as bigint) as g_start, cast(120 + n_nationkey * 80 as bigint) as g_end,
        case when n_nationkey % 2 = 0 then '+' else '-' end as g_strand, concat('gene', cast(n_nationkey as string)) as gene_id from nation""",
    "reads_": """select o_orderkey as read_id, concat('chr', cast(o_custkey % 3 as string)) as chr, case when o_orderstatus = 'O' then '+' else '-' end as strand,
        cast(o_custkey % 500 as int) + 1 as stop_pos, cast(l_partkey % 500 as int) + 1 as mut_pos
        from orders join lineitem on o_orderkey = l_orderkey where l_discount >= 0.05""",
    "replicates_": """select concat('chr', cast(l_suppkey % 3 as string)) as chr, '+' as strand, cast(l_partkey as int) as pos,
        cast(case when l_linenumber % 2 = 1 then 1 else 2 end as int) as grp, cast(l_orderkey * 10 + l_linenumber as bigint) as pair, cast(l_quantity as double) as value from lineitem""",
}
CTE["rates_"] = """
  select m.chr, m.strand, m.pos, m.mut_count as m_mut_count, m.stop_count as m_stop_count, m.depth as m_depth, u.mut_count as u_mut_count, u.stop_count as u_stop_count, u.depth as u_depth,
    case when m.depth > 0 then cast(m.stop_count as double) / m.depth else 0.0 end as m_stop, case when m.depth > 0 then cast(m.mut_count as double) / m.depth else 0.0 end as m_mut,
    case when u.depth > 0 then cast(u.stop_count as double) / u.depth else 0.0 end as u_stop, case when u.depth > 0 then cast(u.mut_count as double) / u.depth else 0.0 end as u_mut
  from pileup_mod_ m join pileup_unmod_ u on m.chr = u.chr and m.strand = u.strand and m.pos = u.pos"""
CTE["signal_"] = "select chr, strand, pos, m_stop - u_stop as stop, m_mut - u_mut as mutation, u_mut >= 0.25 as masked from rates_"
NEEDS = {"rates_": ["pileup_mod_", "pileup_unmod_"], "signal_": ["rates_"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL with the named views in front; a body that begins with 'with' adds its own."""
    parts = [f"{n} as ({CTE[n].replace('as string', 'as varchar')})" for n in _closure(list(names))]
    body = body.strip()
    if body.lower().startswith("with "):
        parts.append(body[5:].strip())
        return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the proxy views as a DataFrame (tables are bound by argument, no global views)."""
    used = _closure([name])
    sql = ", ".join(f"{n} as ({CTE[n]})" for n in used)
    text = f"with {sql} select * from {name}"
    tables = [t for t in TABLES if any(t in CTE[n] for n in used)]
    text = reduce(lambda s, t: re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", s), tables, text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})
