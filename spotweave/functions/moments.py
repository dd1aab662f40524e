"""Power sums of (pred, true) pairs: one mergeable state behind every correlation and error metric.

The sums add up, so a table is reduced once at a fine key and rolled up from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.functions.scalars import finite

SUMS = ["n", "sp", "st", "spp", "stt", "spt", "sae", "sse", "nz"]

# A sum of squares this small next to the raw second moment is rounding noise, i.e. a constant column.
NOISE = 1.0e-12


def _sums(prefix: str) -> list[Column]:
    p, t = F.col(prefix + "_p"), F.col(prefix + "_t")
    e = p - t
    zero = F.lit(0.0)
    total = lambda c, name: F.coalesce(F.sum(c), zero).alias(prefix + name)
    return [
        F.count(p).alias(prefix + "n"),
        total(p, "sp"),
        total(t, "st"),
        total(p * p, "spp"),
        total(t * t, "stt"),
        total(p * t, "spt"),
        total(F.abs(e), "sae"),
        total(e * e, "sse"),
        F.count(F.when(t > 0, 1)).alias(prefix + "nz"),
    ]


def sum_pairs(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str | Column, str | Column]] | None = None) -> DataFrame:
    """Power sums per group, for one or several (pred, true) pairs side by side, told apart by a prefix.

    The values are projected first, so that the aggregate works on plain columns and its generated code stays small.
    Pairs with a non-finite side do not count.
    """
    pairs = pairs or {"": ("pred", "true")}
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    raw = [as_col(c).cast("double").alias(f"{k}_{side}") for k, pt in pairs.items() for side, c in zip("xy", pt)]
    clean = []
    for k in pairs:
        x, y = F.col(f"{k}_x"), F.col(f"{k}_y")
        ok = finite(x) & finite(y)
        clean += [F.when(ok, x).alias(f"{k}_p"), F.when(ok, y).alias(f"{k}_t")]
    return df.select(*keys, *raw).select(*keys, *clean).groupBy(*keys).agg(*[a for k in pairs for a in _sums(k)])


def merged_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def stack_sums(df: DataFrame, keys: list[str], prefixes: dict[str, str], name: str) -> DataFrame:
    """One row per prefix of a table that holds several prefixed sets of sums side by side."""
    sets = [
        F.struct(F.lit(label).alias(name), *[F.col(prefix + c).alias(c) for c in SUMS])
        for label, prefix in prefixes.items()
    ]
    return df.select(*keys, F.explode(F.array(*sets)).alias("_set")).select(*keys, "_set.*")


def _spread(total: str, squares: str) -> Column:
    raw = F.col(squares) - F.col(total) * F.col(total) / F.col("n")
    return F.when(raw > F.lit(NOISE) * F.col(squares), raw).otherwise(F.lit(0.0))


def pearson_of_sums() -> Column:
    """Defined from three pairs on, and only if both sides vary."""
    vp, vt = _spread("sp", "spp"), _spread("st", "stt")
    num = F.col("spt") - F.col("sp") * F.col("st") / F.col("n")
    return F.when((F.col("n") >= 3) & (vp > 0) & (vt > 0), num / F.sqrt(vp * vt))


def pearson(x: str, y: str) -> Column:
    """The same correlation as one aggregate over finite columns, by central moments. `corr` itself fails on a
    constant column in ANSI mode."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    varies = (vx > F.lit(NOISE) * F.avg(F.col(x) * F.col(x))) & (vy > F.lit(NOISE) * F.avg(F.col(y) * F.col(y)))
    return F.when((F.count(x) >= 3) & varies, F.covar_pop(x, y) / F.sqrt(vx * vy))


def _per_n(c: Column) -> Column:
    return F.when(F.col("n") > 0, c / F.col("n"))


def metric_columns(count_name: str = "n_obs", detected: bool = False, prefix: str = "") -> list[Column]:
    cols = {
        count_name: F.col("n"),
        "pearson": pearson_of_sums(),
        "mae": _per_n(F.col("sae")),
        "rmse": F.sqrt(_per_n(F.col("sse"))),
        "true_mean": _per_n(F.col("st")),
        "pred_mean": _per_n(F.col("sp")),
        "true_std": F.sqrt(_per_n(_spread("st", "stt"))),
        "pred_std": F.sqrt(_per_n(_spread("sp", "spp"))),
    }
    if detected:
        cols["detected_fraction"] = _per_n(F.col("nz"))
    return [c.alias(prefix + name) for name, c in cols.items()]


def r2_of_sums() -> Column:
    vt = _spread("st", "stt")
    return F.when((F.col("n") >= 2) & (vt > 0), F.lit(1.0) - F.col("sse") / vt)


def pair_metrics(
    df: DataFrame, keys: list[str], pred: str = "pred", true: str = "true", count_name: str = "n_obs", detected: bool = False
) -> DataFrame:
    """Group, reduce and finish in one step."""
    return (
        sum_pairs(df, keys, {"": (pred, true)})
        .select(*keys, *metric_columns(count_name, detected))
    )
