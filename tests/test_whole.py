"""Queries over the whole of their input, on tables that are larger than the first few hundred keys.

The SQL of these queries once held cuts; it is run here where cuts would show.
"""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from helixframe.plans import catalogue, cli
from helixframe.sources import tables
from helixframe.viz import layout, svg

from .helpers import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["duet_windows", "duet_window_means", "duet_contiguity", "duet_feature_counts", "transcripts_splice", "compare_replicates_ttest", "compare_wilcoxon", "scan_q_top", "shift_matches", "auto_shift_best"])
def test_whole_tables(spark, name):
    same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


def test_splice_all_exons(spark):
    assert sum(r["n_exons"] for r in catalogue.queries()["transcripts_splice"](spark, SF).collect()) == spark.read.parquet(f"{SF}/part.parquet").count()


def test_sql_has_no_cuts():
    assert not re.search(r"(?:pos|key) <= \d", " ".join(catalogue.oracle_sql().values()))


def test_plot_draws_every_high_strand(spark, tmp_path):
    p = spark.range(60 * 5).select(
        F.concat(F.lit("g"), F.col("id") % 60).alias("chr"), F.lit("+").alias("strand"), (F.floor(F.col("id") / 60) + 1).cast("int").alias("pos"), F.lit("A").alias("base"),
        *[F.lit(n).cast("long").alias(c) for c, n in (("mut_count", 5), ("stop_count", 7), ("depth", 100), ("ins", 0), ("del", 0), ("base_a", 95), ("base_c", 5), ("base_g", 0), ("base_t", 0))],
    )
    tables.write_pileup(p, f"{tmp_path}/p")
    a = cli.parser().parse_args(["plot", "--mod", f"{tmp_path}/p", "--output", f"{tmp_path}/out"])
    a.run(spark, a)
    names = {d.removeprefix("name=") for d in os.listdir(f"{tmp_path}/out") if d.startswith("name=")}
    assert names == {"coverage"} | {f"g{i}_%2B_{s}" for i in range(60) for s in ("stop", "mutation")} or names == {"coverage"} | {f"g{i}_+_{s}" for i in range(60) for s in ("stop", "mutation")}
    one = spark.read.text(f"{tmp_path}/out", wholetext=True).where("name = 'g7_+_stop'").first()["value"].strip()
    assert one == svg.signal_figure(p.where("chr = 'g7'"), "stop", "g7 +")


def test_figures_leave_no_group_out(spark):
    curve = spark.range(25 * 3).select(F.concat(F.lit("s"), F.col("id") % 25).alias("chr"), (F.floor(F.col("id") / 25) / 2).alias("fpr"), F.lit(0.5).alias("tpr"))
    assert svg.roc_figure(curve, ["chr"]).count('fill="none" stroke="#') == 25 + 1  # and the axis
    bases = spark.range(90 * 50).select((F.col("id") % 90).alias("ensemble"), F.floor(F.col("id") / 90).cast("int").alias("pos"), F.lit(0.5).alias("confidence"), F.lit(3).alias("reads"))
    figure = svg.ensemble_figure(bases)
    assert all(f">{i}</text>" in figure for i in range(90))
    assert layout.matrix(bases)[2].shape == (90, 50) and (layout.matrix(bases)[2] == 0.5).all()
    genes = spark.range(5000).select((F.col("id") / 5000).alias("coverage"), (F.col("id") * 0.01).alias("avg_depth"), F.lit(False).alias("high"))
    assert min(float(x) for x in re.findall(r'cx="([\d.]+)"', svg.coverage_figure(genes))) == svg.MARGIN


@pytest.mark.parametrize("name", ["shift_matches", "auto_shift_best", "evaluate_both_signals"])
def test_structure_is_not_multiplied_by_shifts(spark, name):
    own = spark.newSession()
    own.conf.set("spark.sql.maxBroadcastTableSize", "40m")  # sf0.1 has 20,000 positions; times 41 shifts they exceed it
    same(catalogue.queries()[name](own, "/root/testdata/sf0.1"), catalogue.oracle_sql()[name], "/root/testdata/sf0.1")


def test_structure_is_not_broadcast(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")  # of the pileups, which are small here
    own.conf.set("spark.sql.maxBroadcastTableSize", "64k")  # sf0.1 has 20,000 positions; they exceed it
    same(catalogue.queries()["shift_matches"](own, "/root/testdata/sf0.1"), catalogue.oracle_sql()["shift_matches"], "/root/testdata/sf0.1")
