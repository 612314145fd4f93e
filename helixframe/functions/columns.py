"""Scalar functions as Spark column expressions.

NaN differs between Spark and IEEE comparisons (Spark: NaN equals NaN and is
larger than any number), so every comparison with a signal goes through
``above``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def above(x: Column, limit: Column | float, equal: bool = False) -> Column:
    """x > limit (or >=), false for NaN and null."""
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.coalesce(~F.isnan(x) & ((x >= limit) if equal else (x > limit)), F.lit(False))


def used_depth(depth: Column, effective: Column | None = None) -> Column:
    """Effective depth where there is one, else depth."""
    return depth if effective is None else F.coalesce(effective, depth)


def rate(count: Column, depth: Column) -> Column:
    """count / depth; 0 where depth is 0 or less."""
    return F.when(depth > 0, count.cast("double") / depth).otherwise(F.lit(0.0))


def k_corrected(mod: Column, unmod: Column, k: Column | float) -> Column:
    """mod - k * unmod; negative values stay."""
    return mod - (k if isinstance(k, Column) else F.lit(float(k))) * unmod


def log_difference(mod: Column, unmod: Column, pseudocount: float = 1.0) -> Column:
    """max(0, ln(mod + p) - ln(unmod + p))."""
    p = F.lit(float(pseudocount))
    return F.greatest(F.lit(0.0), F.log(mod + p) - F.log(unmod + p))


def mask_snp(value: Column, unmod_mutation_rate: Column, cutoff: float = 0.25) -> Column:
    """NaN where the control's mutation rate reaches the cutoff."""
    return F.when(above(unmod_mutation_rate, cutoff, equal=True), F.lit(NAN)).otherwise(value)


def linear_remap(x: Column, top: Column) -> Column:
    """Piecewise-linear map: [0, .25) to [0, .35), [.25, .3) to [.35, .55), [.3, .7) to [.55, .85), .7 and more to .85-1.

    ``top`` is the group's maximum. Negative values stay negative, NaN stays NaN.
    """
    rest = F.when(top > 0.7, F.lit(0.85) + (x - 0.7) / (top - 0.7) * 0.15).otherwise(F.lit(0.85))
    return (
        F.when(F.isnan(x), x)
        .when(x < 0.25, x / 0.25 * 0.35)
        .when(x < 0.3, F.lit(0.35) + (x - 0.25) / 0.05 * 0.2)
        .when(x < 0.7, F.lit(0.55) + (x - 0.3) / 0.4 * 0.3)
        .otherwise(rest)
    )


def base_code(base: Column) -> Column:
    """Bit code of a base: A 1, C 2, G 4, T or U 8, anything else 15; case does not matter."""
    b = F.upper(base)
    return F.when(b == "A", 1).when(b == "C", 2).when(b == "G", 4).when(b.isin("T", "U"), 8).otherwise(15)


def normalize_base(base: Column) -> Column:
    """Upper case, U as T."""
    return F.translate(F.upper(base), "U", "T")


def same_base(a: Column, b: Column) -> Column:
    return normalize_base(a) == normalize_base(b)


def non_reference_count(ref: Column, a: Column, c: Column, g: Column, t: Column) -> Column:
    """Sum of the counts of bases other than the reference; 0 for an unknown reference."""
    r = normalize_base(ref)
    return F.when(r == "A", c + g + t).when(r == "C", a + g + t).when(r == "G", a + c + t).when(r == "T", a + c + g).otherwise(F.lit(0).cast("long"))


def strand_choice(text: str) -> list[str]:
    """Strands named by a filter: '+', '-' or both."""
    return {"+": ["+"], "-": ["-"], "forward": ["+"], "reverse": ["-"]}.get(text.strip().lower(), ["+", "-"])


def cell_label(path: Column) -> Column:
    """Cell of a file: RHX and what follows of [RHX0-9], else what follows the last underscore of the stem, else the stem."""
    stem = F.regexp_extract(path, r"([^/\\]*?)(\.sort)?(\.bam|\.sam)?$", 1)
    found = F.regexp_extract(stem, r"(RHX[RHX0-9]*)", 1)
    tail = F.regexp_extract(stem, r"_([^_]+)$", 1)
    return F.when(found != "", found).when(tail != "", tail).otherwise(stem)


def fold_change(a: Column, b: Column) -> Column:
    """a / b; infinity for b = 0 < a, 1 if both are 0."""
    return F.when(b > 0, a / b).when(a > 0, F.lit(INF)).otherwise(F.lit(1.0))


def modification_score(stop_fold: Column, mutation_fold: Column) -> Column:
    return (stop_fold + mutation_fold) / 2.0


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    # fixed values: the polynomial's coefficients
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / F.lit(2.0**0.5)))


def two_sided_p(z: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def chi_square_cdf(x: Column, df: int) -> Column:
    """Normal approximation (x - df) / sqrt(2 df); 0 for x <= 0."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(normal_cdf((x - df) / F.lit((2.0 * df) ** 0.5)))


def chi_square_model(depth: Column, a: Column, scale: Column) -> Column:
    """a / 2 * exp(-depth / (2 scale)), depth at least 1e-10."""
    return a * 0.5 * F.exp(-F.greatest(depth, F.lit(1e-10)) / (2.0 * scale))


def correction_factor(model_rate: Column, target: Column, depth: Column, weight_increase: float = 1.0) -> Column:
    """Depth factor: above the target 1 + sqrt(excess) * weight, else a falling base plus a logarithmic share, within .5 and 1."""
    up = 1.0 + F.sqrt(F.greatest((model_rate - target) / target, F.lit(0.0))) * weight_increase
    base = 0.88 + 0.12 / (1.0 + F.pow(depth / 500.0, F.lit(2.0)))
    base = F.when(depth > 1000, base - 0.08 * F.log10(depth / 1000.0)).otherwise(base)
    down = F.least(F.greatest(base + (1.0 - base) * F.log2(1.0 + model_rate / target), F.lit(0.5)), F.lit(1.0))
    return F.when(model_rate > target, up).otherwise(down)


def corrected_depth(depth: Column, factor: Column) -> Column:
    """round(depth * factor), the factor within .5 and 10, at least 1."""
    return F.greatest(F.round(depth * F.least(F.greatest(factor, F.lit(0.5)), F.lit(10.0))).cast("long"), F.lit(1).cast("long"))


def fixed_effective_depth(depth: Column, mut_rate: Column, weight_increase: float = 1.0, weight_decrease: float = 0.5) -> Column:
    """Effective depth from fixed parameters (target .015, scale 200, a .15), for data too thin for a fit; truncated, at least 1.

    The two branches are those of ``correction_factor``, the lower one weighed
    by ``weight_decrease``; rates of 0 or above .1 leave the depth as it is.
    """
    target, scale, a = F.lit(0.015), F.lit(200.0), F.lit(0.15)
    y = chi_square_model(depth.cast("double"), a, scale)
    base = 0.88 + 0.12 / (1.0 + F.pow(depth / 500.0, F.lit(2.0)))
    base = F.when(depth > 1000, F.greatest(base - 0.08 * F.log10(depth / 1000.0), F.lit(0.5))).otherwise(base)
    factor = F.when(y > target, 1.0 + F.sqrt(F.greatest((y - target) / target, F.lit(0.0))) * weight_increase).otherwise(base + (1.0 - base) * F.log2(1.0 + y / target) * weight_decrease)
    factor = F.least(F.greatest(factor, F.lit(0.5)), F.lit(10.0))
    fits = (mut_rate > 0) & (mut_rate <= 0.1)
    return F.when(fits, F.greatest((depth * factor).cast("long"), F.lit(1).cast("long"))).otherwise(depth.cast("long"))


def relative_position(pos: Column, start: Column) -> Column:
    return (pos - start + 1).cast("int")


def safe_name(name: Column) -> Column:
    """Slash, backslash, colon, pipe and space as underscores."""
    return F.translate(name, "/\\:| ", "_____")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; letters other than ACGT become N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGTN]", "N"), "ACGT", "TGCA"))


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """Bases start to end, 1-based and closed; empty if any part lies outside."""
    ok = (start >= 1) & (end >= start) & (end <= F.length(seq))
    return F.when(ok, F.substring(seq, start.cast("int"), (end - start + 1).cast("int"))).otherwise(F.lit(""))


def wrap_fasta(seq: Column, width: int = 80) -> Column:
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def parse_signal(text: Column) -> Column:
    """Text to double, 'NaN' kept, anything else that is no number null."""
    return text.try_cast("double")


def position_confidence(reads: Column, stop: Column, mutation: Column) -> Column:
    """0.6 (1 - exp(-reads / 50)) + 0.4 clamp(max(stop, mutation), 0, 1)."""
    top = F.greatest(F.nanvl(stop, F.lit(0.0)), F.nanvl(mutation, F.lit(0.0)))
    return 0.6 * (1.0 - F.exp(-reads / 50.0)) + 0.4 * F.least(F.greatest(top, F.lit(0.0)), F.lit(1.0))


def color_bucket(value: Column, ranges: list[tuple[float, float, str]], missing: str = "#808080") -> Column:
    """Colour of the range [low, high) a value falls in, the last range closed; outside values take the nearest range.

    -1, NaN, infinities and nulls are missing.
    """
    v = value
    out = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == INF) | (v == -1.0), missing).when(v < ranges[0][0], ranges[0][2])
    for low, high, color in ranges[:-1]:
        out = out.when((v >= low) & (v < high), color)
    return out.otherwise(ranges[-1][2])


#: Default colour ranges of each base.
DEFAULT_RANGES = [(0.0, 0.3, "#d9d9d9"), (0.3, 0.65, "#f5c04a"), (0.65, 1.0, "#d7301f")]


def diffscan(a: Column, b: Column) -> tuple[Column, Column]:
    """(p, significant) of two signals: difference above .3, one above .2, both above .05."""
    d = F.abs(a - b)
    sig = (d > 0.3) & ((a > 0.2) | (b > 0.2)) & (a > 0.05) & (b > 0.05)
    p = F.when(sig & (d > 0.6), 0.001).when(sig & (d > 0.4), 0.01).when(sig, 0.05).otherwise(0.5)
    return p, F.coalesce(sig, F.lit(False))
