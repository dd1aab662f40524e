"""Choosing samples and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotweave.checks import require_none, require_rows
from spotweave.operators.sizefactor import SAMPLE


def cohort_filter(samples: DataFrame, species: str = "Homo sapiens", technology: str = "Visium", min_spots: int = 200) -> DataFrame:
    keep = (F.col("species") == species) & (F.col("st_technology") == technology) & (F.col("spots_under_tissue") >= min_spots)
    return samples.filter(keep).orderBy("organ", "dataset_title", SAMPLE)


def in_splits(df: DataFrame, splits: list[str]) -> DataFrame:
    return require_rows(df.filter(F.col("split").isin(splits)), f"no rows in splits {splits}")


def select_samples(samples: DataFrame, ids: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Samples on a list of ids; ids the table does not know are an error. `first` keeps the first n by id."""
    out = samples
    if ids is not None:
        require_none(ids.select(SAMPLE).join(samples.select(SAMPLE), SAMPLE, "left_anti"), "unknown sample ids")
        out = out.join(ids.select(SAMPLE).distinct(), SAMPLE, "left_semi")
    return out.orderBy(SAMPLE).limit(first) if first is not None else out


def select_tasks(tasks: DataFrame, split_types: list[str] | None = None, slugs: list[str] | None = None, heldouts: list[str] | None = None, first: int | None = None) -> DataFrame:
    out = tasks
    for col, values in (("split_type", split_types), ("task_slug", slugs), ("heldout", heldouts)):
        if values:
            out = out.filter(F.col(col).isin(values))
    if first is not None:
        out = out.orderBy("split_type", "task_slug").limit(first)
    return require_rows(out, "no task selected")


def gene_classes(genes: DataFrame, classes: DataFrame, other: str = "other") -> DataFrame:
    """First class by priority that lists the gene. `classes` (priority, gene_class, gene) is a fixed short list."""
    hit = classes.groupBy("gene").agg(F.min_by("gene_class", "priority").alias("gene_class"))
    return genes.join(F.broadcast(hit), "gene", "left").withColumn("gene_class", F.coalesce("gene_class", F.lit(other)))


def scaled_coordinates(spots: DataFrame, sizes: DataFrame) -> DataFrame:
    """Full-resolution pixels to thumbnail pixels."""
    j = spots.join(sizes.select(SAMPLE, "full_width", "full_height", "thumb_width", "thumb_height"), SAMPLE)
    return j.withColumn("thumb_x", F.col("x") * F.col("thumb_width") / F.col("full_width")).withColumn(
        "thumb_y", F.col("y") * F.col("thumb_height") / F.col("full_height")
    )


def first_non_empty(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The manifest if it has rows, else the filtered metadata."""
    return fallback if primary.isEmpty() else primary
