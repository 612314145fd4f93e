"""SVG figures. Tables are aggregated in Spark; longer series are binned (``MAX_MARKS``), no group is left out."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DEFAULT_RANGES, color_bucket, normalize_base

#: A series of more points is averaged into this many bins before it is collected.
MAX_MARKS = 4000

WIDTH, HEIGHT, MARGIN = 900, 320, 50


def binned(df: DataFrame, x: str, ys: Sequence[str], marks: int = MAX_MARKS) -> list[tuple]:
    """(x, means of ys) in order of x, in at most ``marks`` bins of equal width."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return []
    width = max((hi - lo) / marks, 1e-12)
    b = F.least(F.floor((F.col(x) - lo) / width), F.lit(marks - 1))
    rows = df.groupBy(b.alias("_b")).agg(F.avg(x).alias("_x"), *[F.avg(F.when(~F.isnan(F.col(y).cast("double")), F.col(y))).alias(y) for y in ys]).orderBy("_b").collect()
    return [(r["_x"], *[r[y] for y in ys]) for r in rows]


def binned_by(df: DataFrame, keys: list[str], x: str, ys: Sequence[str], marks: int = MAX_MARKS) -> DataFrame:
    """keys, _b, _x, ys: ``binned`` for every group of keys at once."""
    edge = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / marks, F.lit(1e-12))
    b = F.least(F.floor((F.col(x) - F.col("_lo")) / width), F.lit(marks - 1))
    return df.join(edge, keys).groupBy(*keys, b.alias("_b")).agg(F.avg(x).alias("_x"), *[F.avg(F.when(~F.isnan(F.col(y).cast("double")), F.col(y))).alias(y) for y in ys])


def _scale(values: Sequence[float], low: float, high: float):
    v = [x for x in values if x is not None]
    a, b = (min(v), max(v)) if v else (0.0, 1.0)
    span = (b - a) or 1.0
    return lambda x: low + (x - a) / span * (high - low)


def _frame(body: str, title: str, x_label: str, y_label: str) -> str:
    axis = f'<path d="M{MARGIN},{MARGIN} V{HEIGHT - MARGIN} H{WIDTH - MARGIN}" fill="none" stroke="#333"/>'
    labels = f'<text x="{WIDTH / 2}" y="20" text-anchor="middle">{escape(title)}</text><text x="{WIDTH / 2}" y="{HEIGHT - 10}" text-anchor="middle">{escape(x_label)}</text><text x="14" y="{HEIGHT / 2}" transform="rotate(-90 14 {HEIGHT / 2})" text-anchor="middle">{escape(y_label)}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12">{axis}{labels}{body}</svg>'


def lines(series: dict[str, list[tuple[float, float]]], title: str, x_label: str = "", y_label: str = "", diagonal: bool = False) -> str:
    """Polylines of named series; missing values break a line."""
    colors = ("#1b6ca8", "#d7301f", "#2e8b57", "#8856a7", "#e08214", "#555555")
    xs, ys = ([p[i] for s in series.values() for p in s] for i in (0, 1))
    sx, sy = _scale(xs, MARGIN, WIDTH - MARGIN), _scale(ys, HEIGHT - MARGIN, MARGIN)
    body = f'<path d="M{MARGIN},{HEIGHT - MARGIN} L{WIDTH - MARGIN},{MARGIN}" stroke="#bbb" stroke-dasharray="4"/>' if diagonal else ""
    for i, (name, points) in enumerate(series.items()):
        path, pen = "", "M"
        for x, y in points:
            if y is None:
                pen = "M"
            else:
                path += f"{pen}{sx(x):.1f},{sy(y):.1f} "
                pen = "L"
        c = colors[i % len(colors)]
        body += f'<path d="{path}" fill="none" stroke="{c}"/><text x="{WIDTH - MARGIN + 4}" y="{MARGIN + 14 * i}" fill="{c}">{escape(name)}</text>'
    return _frame(body, title, x_label, y_label)


def scatter(points: list[tuple[float, float, str]], title: str, x_label: str = "", y_label: str = "") -> str:
    sx, sy = _scale([p[0] for p in points], MARGIN, WIDTH - MARGIN), _scale([p[1] for p in points], HEIGHT - MARGIN, MARGIN)
    return _frame("".join(f'<circle cx="{sx(x):.1f}" cy="{sy(y):.1f}" r="3" fill="{c}" fill-opacity="0.7"/>' for x, y, c in points), title, x_label, y_label)


def bars(points: list[tuple[float, float, str]], title: str, x_label: str = "", y_label: str = "") -> str:
    sx, sy = _scale([p[0] for p in points], MARGIN, WIDTH - MARGIN), _scale([0.0, *[p[1] for p in points if p[1] is not None]], HEIGHT - MARGIN, MARGIN)
    w = max(1.0, (WIDTH - 2 * MARGIN) / max(1, len(points)) * 0.9)
    out = "".join(f'<rect x="{sx(x):.1f}" y="{min(sy(y), sy(0)):.1f}" width="{w:.1f}" height="{abs(sy(0) - sy(y)):.1f}" fill="{c}"/>' for x, y, c in points if y is not None)
    return _frame(out, title, x_label, y_label)


def heatmap(rows: list[str], columns: list[int], value: dict[tuple[str, int], float], title: str) -> str:
    top = max(value.values(), default=1.0) or 1.0
    w, h = (WIDTH - 2 * MARGIN) / max(1, len(columns)), (HEIGHT - 2 * MARGIN) / max(1, len(rows))
    cells = "".join(f'<rect x="{MARGIN + j * w:.1f}" y="{MARGIN + i * h:.1f}" width="{w:.2f}" height="{h:.2f}" fill="#d7301f" fill-opacity="{max(0.0, v) / top:.3f}"/>' for i, r in enumerate(rows) for j, c in enumerate(columns) if (v := value.get((r, c))) is not None)
    return _frame(cells + "".join(f'<text x="{MARGIN - 4}" y="{MARGIN + (i + 0.7) * h:.1f}" text-anchor="end">{escape(r)}</text>' for i, r in enumerate(rows)), title, "position", "ensemble")


def signal_figure(pileup: DataFrame, signal: str, title: str) -> str:
    """Rate of stops or mutations along one gene's strand."""
    count = {"stop": "stop_count", "mutation": "mut_count"}[signal]
    p = pileup.select("pos", F.when(F.col("depth") > 0, F.col(count) / F.col("depth")).otherwise(0.0).alias("y"))
    return lines({signal: binned(p, "pos", ["y"])}, title, "position", f"{signal} rate")


def signal_figures(pileup: DataFrame, unmod: DataFrame | None = None, reactivity: DataFrame | None = None) -> DataFrame:
    """name, value: figures of every strand, drawn on the executors from at most MAX_MARKS bins a line.

    Stop and mutation rates, those of a control beside them, and, where there
    is any, both reactivities.
    """
    rate = lambda c: F.when(F.col("depth") > 0, F.col(c) / F.col("depth")).otherwise(0.0)
    counts = {"stop": "stop_count", "mutation": "mut_count"}

    def rates(p: DataFrame, name: str | None) -> DataFrame:
        each = [F.struct(F.lit(s).alias("figure"), F.lit(name or s).alias("series"), rate(c).alias("y")) for s, c in counts.items()]
        return p.select("chr", "strand", "pos", F.explode(F.array(*each)).alias("f")).select("chr", "strand", "f.figure", "f.series", "pos", "f.y")

    long = rates(pileup, None if unmod is None else "modified")
    if unmod is not None:
        long = long.unionByName(rates(unmod, "control"))
    if reactivity is not None:
        each = [F.struct(F.lit(f"reactivity_{s}").alias("figure"), F.lit(f"{s} reactivity").alias("series"), F.col(f"reactivity_{s}").alias("y")) for s in counts]
        long = long.unionByName(reactivity.join(pileup.select("chr", "strand").distinct(), ["chr", "strand"], "left_semi").select("chr", "strand", "pos", F.explode(F.array(*each)).alias("f")).select("chr", "strand", "f.figure", "f.series", "pos", "f.y"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        at, strand, figure = (g[c].iloc[0] for c in ("chr", "strand", "figure"))
        points = lambda p: [(x, None if math.isnan(y) else y) for x, y in zip(p["_x"], p["y"].astype(float), strict=True)]
        series = {name: points(p.sort_values("_b")) for name, p in g.sort_values("series", ascending=False).groupby("series", sort=False)}
        label = "reactivity" if figure.startswith("reactivity") else f"{figure} rate"
        return pd.DataFrame([(f"{at}_{strand}_{figure}", lines(series, f"{at} {strand}", "position", label))], columns=["name", "value"])

    return binned_by(long, ["chr", "strand", "figure", "series"], "pos", ["y"]).groupBy("chr", "strand", "figure").applyInPandas(run, "name string, value string")


def reactivity_figure(reactivity: DataFrame, signal: str, title: str) -> str:
    """Bars coloured by the default ranges."""
    pts = binned(reactivity.select("pos", F.col(f"reactivity_{signal}").alias("y")), "pos", ["y"])
    color = lambda y: next((c for a, b, c in DEFAULT_RANGES if y is not None and y < b), DEFAULT_RANGES[-1][2])
    return bars([(x, y, color(y)) for x, y in pts], title, "position", "reactivity")


def coverage_figure(stats: DataFrame, title: str = "genes") -> str:
    """Coverage against log10(depth + 1) of ``extract.gene_stats``; of more than MAX_MARKS genes, one mark for each cell of 1/200 by 1/20 that holds any."""
    genes = stats.select("coverage", F.log10(F.col("avg_depth") + 1).alias("d"), "high")
    if genes.count() > MAX_MARKS:
        genes = genes.groupBy("high", F.floor(F.col("coverage") * 200), F.floor(F.col("d") * 20)).agg(F.avg("coverage").alias("coverage"), F.avg("d").alias("d"))
    rows = genes.orderBy(F.col("d").desc(), "coverage", "high").collect()
    return scatter([(r["coverage"], r["d"], "#d7301f" if r["high"] else "#888888") for r in rows], title, "coverage", "log10(depth + 1)")


def roc_figure(curve: DataFrame, keys: list[str], title: str = "ROC") -> str:
    """One line per group of ``evaluate.curve``."""
    named = curve.withColumn("n", F.concat_ws(" ", *keys) if keys else F.lit("all"))
    series: dict[str, list] = {}
    for r in binned_by(named, ["n"], "fpr", ["tpr"], 400).orderBy("n", "_b").collect():
        series.setdefault(r["n"], [(0.0, 0.0)]).append((r["_x"], r["tpr"]))
    series = {n: [*pts, (1.0, 1.0)] for n, pts in series.items()}
    return lines(series, title, "false positive rate", "true positive rate", diagonal=True)


def pr_figure(curve: DataFrame, title: str = "precision and recall") -> str:
    return lines({"all": binned(curve, "recall", ["precision"], 400)}, title, "recall", "precision")


def ensemble_figure(bases: DataFrame, title: str = "ensembles") -> str:
    """Confidence of ``duet.base_records`` by ensemble and position; of more than MAX_MARKS cells, means over 100 bins of positions for every ensemble."""
    cells = bases.select(F.col("ensemble").cast("string").alias("e"), "pos", "confidence")
    if cells.count() > MAX_MARKS:
        lo, hi = cells.agg(F.min("pos"), F.max("pos")).first()
        step = (hi - lo) // 100 + 1
        cells = cells.groupBy("e", (F.floor((F.col("pos") - lo) / step) * step + lo).alias("pos")).agg(F.avg("confidence").alias("confidence"))
    rows = cells.orderBy("e", "pos").collect()
    return heatmap(sorted({r["e"] for r in rows}), sorted({r["pos"] for r in rows}), {(r["e"], r["pos"]): r["confidence"] for r in rows}, title)


def track_figure(ensembles: DataFrame, title: str = "overlap") -> str:
    """A bar from the first to the last position of every ensemble of ``duet.ensemble_summary``, in order of place; those of 95 % of the longest and more stand out."""
    rows = ensembles.select("chr", "strand", "ensemble", "start", "end").orderBy("chr", "strand", "start", F.col("end").desc(), "ensemble").collect()
    longest = max((r["end"] - r["start"] + 1 for r in rows), default=1)
    sx = _scale([x for r in rows for x in (r["start"], r["end"])], MARGIN, WIDTH - MARGIN)
    h = (HEIGHT - 2 * MARGIN) / max(1, len(rows))
    full = lambda r: r["end"] - r["start"] + 1 >= 0.95 * longest
    bars_ = "".join(
        f'<rect x="{sx(r["start"]):.1f}" y="{MARGIN + i * h:.2f}" width="{max(1.0, sx(r["end"]) - sx(r["start"])):.1f}" height="{0.8 * h:.2f}" fill="{"#d7301f" if full(r) else "#1b6ca8"}"><title>{escape(str(r["ensemble"]))}</title></rect>'
        for i, r in enumerate(rows)
    )
    return _frame(bars_, title, "position", "ensemble")


_LABEL = re.compile(r"position\.label in template: (\d+)\.(\w)")


def template_positions(svg: str) -> list[tuple[int, str]]:
    """(position, base) of the titled circles of a structure drawing."""
    return [(int(p), b) for p, b in _LABEL.findall(svg)]


def color_template(svg: str, reactivity: DataFrame, signal: str = "stop", shift: int | dict[str, int] = 0, bases: str = "ACGT", ranges: Sequence[tuple[float, float, str]] = DEFAULT_RANGES, filled: bool = False) -> str:
    """A structure drawing with a circle at every labelled position, coloured by reactivity at position + shift.

    ``shift`` may differ by base; positions of 100,000 and more are places
    already. Circles go before the closing tag, at the place of the label's
    text; a legend lists the ranges.
    """
    moved = lambda p, b: p if p >= 100_000 else p + (shift if isinstance(shift, int) else shift.get(b.upper().replace("U", "T"), 0))
    place = {p: moved(p, b) for p, b in template_positions(svg)}
    want = reactivity.where(F.lit(bases.replace("U", "T")).contains(normalize_base(F.col("base"))))
    color = {r["pos"]: r["c"] for r in want.where(F.col("pos").isin(list(place.values()))).select("pos", color_bucket(F.col(f"reactivity_{signal}"), list(ranges)).alias("c")).collect()}
    out = []
    for m in _LABEL.finditer(svg):
        at = re.search(r'<text[^>]*\bx="([-\d.]+)"[^>]*\by="([-\d.]+)"', svg[m.end() :])
        if at and (c := color.get(place[int(m[1])])):
            out.append(f'<circle cx="{at[1]}" cy="{at[2]}" r="4" stroke="{c}" fill="{c if filled else "none"}"/>')
    legend = "".join(f'<rect x="5" y="{5 + 18 * i}" width="30" height="15" fill="{c}"/><text x="40" y="{17 + 18 * i}" font-size="10">{a:g}-{b:g}</text>' for i, (a, b, c) in enumerate(ranges))
    return svg.replace("</svg>", f'<g id="reactivity">{"".join(out)}</g><g id="legend">{legend}</g></svg>')


def interactive_html(svg: str, title: str = "structure") -> str:
    """One page with the drawing, zoom by wheel and drag, and positions on hover."""
    script = "const s=document.querySelector('svg');let k=1,x=0,y=0,d=null;const t=()=>s.style.transform=`translate(${x}px,${y}px) scale(${k})`;addEventListener('wheel',e=>{k*=e.deltaY<0?1.1:.9;t()});addEventListener('mousedown',e=>d=[e.x-x,e.y-y]);addEventListener('mousemove',e=>{if(d){x=e.x-d[0];y=e.y-d[1];t()}});addEventListener('mouseup',()=>d=null);"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body>{svg}<script>const data={json.dumps(template_positions(svg))};{script}</script></body></html>"
