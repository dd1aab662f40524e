"""Colour descriptors of image patches that arrive as pixel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NAMES = (
    [f"rgb_mean_{c}" for c in "rgb"] + [f"rgb_std_{c}" for c in "rgb"]
    + [f"rgb_p{q}_{c}" for q in (10, 50, 90) for c in "rgb"]
    + ["gray_mean", "gray_std", "gray_p10", "gray_p50", "gray_p90", "tissue_fraction", "saturation_mean", "saturation_std"]
)


def patch_descriptors(pixels: DataFrame, key: str = "patch_id") -> DataFrame:
    """23 descriptors per patch from (key, r, g, b) rows with values 0–255. A patch has a fixed number of pixels, so
    the exact percentiles keep little state."""
    d = pixels.select(key, *[(F.col(c).cast("double") / 255.0).alias(c) for c in "rgb"])
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    d = d.withColumn("gray", F.lit(0.299) * F.col("r") + F.lit(0.587) * F.col("g") + F.lit(0.114) * F.col("b")).withColumn(
        "sat", (hi - lo) / F.greatest(hi, F.lit(1.0e-6))
    )
    tissue = (F.col("gray") < 0.92) & (F.col("sat") > 0.05)
    aggs = [F.avg(c).alias(f"rgb_mean_{c}") for c in "rgb"] + [F.stddev_pop(c).alias(f"rgb_std_{c}") for c in "rgb"]
    qs = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    aggs += [F.percentile(c, qs).alias(f"_q_{c}") for c in ("r", "g", "b", "gray")]
    aggs += [
        F.avg("gray").alias("gray_mean"), F.stddev_pop("gray").alias("gray_std"), F.avg(tissue.cast("double")).alias("tissue_fraction"),
        F.avg("sat").alias("saturation_mean"), F.stddev_pop("sat").alias("saturation_std"),
    ]
    a = d.groupBy(key).agg(*aggs)
    for i, q in enumerate((10, 50, 90)):
        for c in "rgb":
            a = a.withColumn(f"rgb_p{q}_{c}", F.col(f"_q_{c}")[i])
        a = a.withColumn(f"gray_p{q}", F.col("_q_gray")[i])
    return a.select(key, *NAMES)
