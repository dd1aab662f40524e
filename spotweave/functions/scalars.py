"""Column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that stand for "no gene" and "no label".
NO_GENE = ["", "nan", "none", "null", "unspecified_gene_id"]
NO_LABEL = ["", "nan", "none", "unknown", "not provided"]

# Floors used when dividing by or taking logs of a size factor.
RATE_FLOOR = 1.0e-6
LOG_FLOOR = 1.0e-8

KINDS = ("count", "rate", "log1p_count", "log1p_rate")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def finite(c: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def gene_key(c: Column) -> Column:
    t = _trimmed(c)
    return F.when(~F.lower(t).isin(NO_GENE), t)


def clean_label(c: Column) -> Column:
    t = _trimmed(c)
    return F.when(F.lower(t).isin(NO_LABEL) | t.isNull(), F.lit("")).otherwise(t)


def tolerant_bool(c: Column, default: bool) -> Column:
    t = F.lower(c.cast("string"))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False)).otherwise(F.lit(default))


def blank_to_null(c: Column) -> Column:
    return F.when(_trimmed(c) != "", c.cast("string"))


def slugify(c: Column, max_len: int | None = 80) -> Column:
    """Lower-case words joined by _; cut to `max_len` characters unless that is None."""
    def strip(x: Column) -> Column:
        return F.regexp_replace(x, "^_+|_+$", "")

    words = strip(F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]+", "_"))
    cut = words if max_len is None else strip(F.substring(words, 1, max_len))
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("all")).otherwise(cut)


def stable_score(seed: int, *parts: Column) -> Column:
    """Hex SHA-1 of `seed|part|part…`; orders rows the same way on every run and every engine."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def bounded_name(c: Column, max_len: int = 64) -> Column:
    head = F.regexp_replace(F.substring(c, 1, max_len - 9), "[_-]+$", "")
    digest = F.substring(F.sha1(c.cast("binary")), 1, 8)
    return F.when(F.length(c) <= max_len, c).otherwise(F.concat(head, F.lit("_"), digest))


def quality_tier(c: Column, good: float = 0.65, medium: float = 0.35) -> Column:
    return F.when(c >= good, "good").when(c >= medium, "medium").otherwise("bad")


def rate_of(count: Column, sf: Column) -> Column:
    return count.cast("double") / F.greatest(sf, F.lit(RATE_FLOOR))


def truth_value(kind: str, count: Column, sf: Column) -> Column:
    """The measured value a prediction of this kind is compared with."""
    if kind == "count":
        return count.cast("double")
    if kind == "log1p_count":
        return F.log1p(count.cast("double"))
    if kind == "rate":
        return rate_of(count, sf)
    if kind == "log1p_rate":
        return F.log1p(rate_of(count, sf))
    raise ValueError(f"unknown prediction kind {kind!r}; one of {KINDS}")


def prediction_value(kind: str, value: Column) -> Column:
    """Counts and rates cannot be negative; log values pass through."""
    if kind not in KINDS:
        raise ValueError(f"unknown prediction kind {kind!r}; one of {KINDS}")
    v = value.cast("double")
    return F.greatest(v, F.lit(0.0)) if kind in ("count", "rate") else v


def log_sf_clipped(sf: Column) -> Column:
    return F.log(F.greatest(sf, F.lit(LOG_FLOOR)))


def log_sf_shifted(sf: Column) -> Column:
    return F.log(sf + F.lit(LOG_FLOOR))


def log_gamma(x: Column) -> Column:
    """ln Γ(x), x > 0: the Stirling series at x + 8, brought back by the recurrence.

    Error below 1e-11 for x up to some thousands; Spark has no built-in.
    """
    z = x + F.lit(8.0)
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    series = inv * (
        F.lit(1.0 / 12)
        - inv2 * (F.lit(1.0 / 360) - inv2 * (F.lit(1.0 / 1260) - inv2 * (F.lit(1.0 / 1680) - inv2 * F.lit(1.0 / 1188))))
    )
    stirling = (z - F.lit(0.5)) * F.log(z) - z + F.lit(0.9189385332046727) + series
    product = x
    for i in range(1, 8):
        product = product * (x + F.lit(float(i)))
    return stirling - F.log(product)


def dot(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, v: s + v)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
