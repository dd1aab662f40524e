"""Totals, mean-one size factors and feature standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.checks import require_none, require_rows
from spotweave.functions.scalars import finite, log_sf_clipped, log_sf_shifted, rate_of

SAMPLE = "sample_id"
SPOT = ["sample_id", "spot_id"]


def with_group_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    An aggregate joined back rather than a window: the aggregate combines map-side, and a hot group stays spread over
    many tasks because only one row per group travels to the data. AQE broadcasts that side once it has seen its size.
    """
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(stats, keys, "left") if keys else df.crossJoin(F.broadcast(stats))


def spot_totals(spots: DataFrame, counts: DataFrame) -> DataFrame:
    """Total count per spot; spots without a single count keep a zero."""
    totals = counts.groupBy(*SPOT).agg(F.sum("count").alias("total"))
    return spots.join(totals, SPOT, "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))


def with_named_stats(df: DataFrame, keys: list[str], stats: dict[str, Column], together: bool) -> DataFrame:
    """`together` says that the rows of a group lie in one partition already: a window then moves nothing, a join would move both sides."""
    if not together:
        return with_group_stats(df, keys, *[agg.alias(name) for name, agg in stats.items()])
    return df.select("*", *[agg.over(W.partitionBy(*keys)).alias(name) for name, agg in stats.items()])


def _with_sample_stat(df: DataFrame, keys: list[str], agg: Column, name: str, together: bool) -> DataFrame:
    return with_named_stats(df, keys, {name: agg}, together)


def valid_spot(total: Column, min_total: float = 1.0) -> Column:
    return finite(total.cast("double")) & (total >= F.lit(min_total))


def size_factor(totals: DataFrame, min_total: float = 1.0, strict: bool = False, together: bool = False) -> DataFrame:
    """`sf = total / mean(total of the valid spots of the sample)`, for valid and invalid spots alike."""
    marked = totals.withColumn("valid", valid_spot(F.col("total"), min_total))
    out = _with_sample_stat(marked, [SAMPLE], F.avg(F.when(F.col("valid"), F.col("total"))), "_mean", together)
    if strict:
        require_none(out.filter("_mean IS NULL").select(SAMPLE).distinct(), "samples without a valid spot")
    sf = F.col("total") / F.when(F.col("_mean") > 0, F.col("_mean"))
    return out.withColumn("sf", sf).withColumn("log_sf", log_sf_clipped(F.col("sf"))).drop("_mean")


def stored_size_factor(spots: DataFrame, sf: str = "stored_sf", min_total: float = 1.0) -> DataFrame:
    """Where factors come with the data a spot is valid only if its factor is usable and its total is high enough."""
    ok = finite(F.col(sf)) & (F.col(sf) > 0) & valid_spot(F.col("total"), min_total)
    return spots.withColumn("valid", ok).withColumn("sf", F.col(sf)).withColumn("log_sf", log_sf_clipped(F.col(sf)))


def log_size_factor_of_totals(totals: DataFrame, eps: float = 1.0e-8) -> DataFrame:
    """Variant for raw tables: any positive total is valid, the log is shifted by `eps`."""
    positive = F.when(finite(F.col("total").cast("double")) & (F.col("total") > 0), F.col("total"))
    out = with_group_stats(totals, [SAMPLE], F.avg(positive).alias("_mean"))
    return out.withColumn("log_sf", F.log(F.col("total") / F.col("_mean") + F.lit(eps))).drop("_mean")


def normalise_predicted(
    df: DataFrame, log_sf: str = "pred_log_sf_raw", scope: list[str] | None = None, variant: str = "eps", out: str = "pred_sf", together: bool = False
) -> DataFrame:
    """Predicted factors scaled to mean one per sample, or over any other scope ([] = the whole table).

    plain: divide by the mean; eps: by mean + 1e-8; guarded: leave the group alone if its mean is unusable.
    """
    keys = [SAMPLE] if scope is None else scope
    d = df.withColumn("_sf", F.exp(F.col(log_sf)))
    d = _with_sample_stat(d, keys, F.avg("_sf"), "_mean", together)
    if variant == "plain":
        value = F.col("_sf") / F.when(F.col("_mean") > 0, F.col("_mean"))
    elif variant == "eps":
        value = F.col("_sf") / (F.col("_mean") + F.lit(1.0e-8))
    elif variant == "guarded":
        value = F.when(finite(F.col("_mean")) & (F.col("_mean") > 0), F.col("_sf") / F.col("_mean")).otherwise(F.col("_sf"))
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return d.withColumn(out, value).drop("_sf", "_mean")


def normalised_variants(df: DataFrame, log_sf: str = "pred_log_sf_raw") -> DataFrame:
    """The three variants of `normalise_predicted` side by side, from one mean per sample."""
    d = with_group_stats(df.withColumn("_sf", F.exp(F.col(log_sf))), [SAMPLE], F.avg("_sf").alias("_mean"))
    usable = finite(F.col("_mean")) & (F.col("_mean") > 0)
    return d.select(
        "*", (F.col("_sf") / F.when(F.col("_mean") > 0, F.col("_mean"))).alias("plain"), (F.col("_sf") / (F.col("_mean") + F.lit(1.0e-8))).alias("eps"),
        F.when(usable, F.col("_sf") / F.col("_mean")).otherwise(F.col("_sf")).alias("guarded"),
    ).drop("_sf", "_mean")


def mean_one_log(df: DataFrame, log_sf: str, out: str, together: bool = False) -> DataFrame:
    """Mean-one per sample and back to logs."""
    d = normalise_predicted(df, log_sf, variant="eps", out="_one", together=together)
    return d.withColumn(out, log_sf_shifted(F.col("_one"))).drop("_one")


def fit_standardizer(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: mean[] and std[] per dimension; NaN is skipped, a flat dimension gets std 1."""
    v = F.when(~F.isnan("v"), F.col("v").cast("double"))
    per_dim = (
        df.select(F.posexplode(features).alias("i", "v"))
        .groupBy("i")
        .agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
        .withColumn("s", F.when(F.col("s") < 1.0e-6, F.lit(1.0)).otherwise(F.col("s")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "m", "s")))  # one entry per feature dimension
    return per_dim.agg(ordered.alias("d")).select(F.col("d.m").alias("mean"), F.col("d.s").alias("std"))


def standardize(df: DataFrame, scaler: DataFrame, features: str = "features") -> DataFrame:
    """(x − mean) / std; the scaler is a single row."""
    d = df.crossJoin(F.broadcast(scaler.select(F.col("mean").alias("_m"), F.col("std").alias("_s"))))
    centred = F.zip_with(features, "_m", lambda x, m: x.cast("double") - m)
    return d.withColumn(features, F.zip_with(centred, "_s", lambda x, s: x / s)).drop("_m", "_s")


def sf_training_set(spots: DataFrame, sf: DataFrame, samples: DataFrame, splits: list[str]) -> DataFrame:
    """Valid spots of the chosen splits with standardised features and the log size factor."""
    chosen = samples.filter(F.col("split").isin(splits)).select(SAMPLE, "split")
    require_rows(chosen, f"no sample in splits {splits}")
    target = sf.filter("valid").select(*SPOT, "log_sf")
    d = spots.select(*SPOT, "features").join(chosen, SAMPLE).join(target, SPOT)
    return standardize(d, fit_standardizer(d))


def log1p_rate_targets(pairs: DataFrame) -> DataFrame:
    """From (count, sf) pairs over measured genes to the regression target."""
    return pairs.withColumn("log1p_rate", F.log1p(rate_of(F.col("true_count"), F.col("sf"))))
