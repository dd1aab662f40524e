"""Runs of leave-one-label-out tasks and the mart that keeps their results.

The mart has a row per (run, split type, held-out label, stage), partitioned by run and split type. A run looks at it first: labels whose
stages are all done are not fitted again, labels with another status are. Results are merged by replacing the partitions they touch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.functions.scalars import slugify
from spotweave.operators.linear import generalization_rows
from spotweave.session import materialise

STAGES = ["sf", "expression", "combined"]
KEYS = ["run_name", "split_type", "heldout", "stage"]
SCHEMA = "heldout string, stage string, status string, metric string, value double, run_name string, split_type string"
METRICS = {"sf": "metric_log_sf_pearson", "expression": "metric_mean_gene_pearson", "combined": "metric_count_pred_sf_mean_gene_pearson"}


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the mart; none where it does not exist yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def merge_results(path: str, new: DataFrame) -> None:
    """`new` replaces the rows of its keys. Rows of touched partitions are stored aside before the partitions are replaced."""
    new = materialise(new.select(*KEYS, "status", "metric", "value"))
    part = KEYS[:2]
    kept = read_results(new.sparkSession, path).join(new.select(*part).distinct(), part, "left_semi").join(new.select(*KEYS), KEYS, "left_anti")
    merged = materialise(kept.unionByName(new))
    merged.repartition(*part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def pending(tasks: DataFrame, results: DataFrame, run_name: str) -> DataFrame:
    """(split_type, heldout) of the tasks that lack a finished stage in this run."""
    wanted = tasks.select("split_type", "heldout").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in STAGES])))
    done = results.filter((F.col("run_name") == run_name) & (F.col("status") == "ok")).select(*KEYS[1:])
    return wanted.join(done, KEYS[1:], "left_anti").select("split_type", "heldout").distinct()


def run_tasks(df: DataFrame, genes: DataFrame, tasks: DataFrame, labels: dict[str, str], path: str, prefix: str = "formal_", alpha: float = 10.0) -> DataFrame:
    """Fit and evaluate what is pending, a run per split type named `prefix` + split type, and return the mart.

    `tasks` has split_type and heldout; `labels` names the label column of `df` per split type. See `generalization_rows` for the rest.
    A label without training rows, or that no row has, keeps its status row and is tried again by the next run. If a run fails, its pending
    labels get rows of status error, then the failure is raised; finished runs stay.
    """
    spark = df.sparkSession
    for split_type, column in labels.items():
        run = prefix + split_type
        mine = tasks.filter(F.col("split_type") == split_type)
        todo = materialise(pending(mine, read_results(spark, path), run).select("heldout"))
        if todo.isEmpty():
            continue
        named = lambda d: d.withColumn("run_name", F.lit(run)).withColumn("split_type", F.lit(split_type))
        try:
            merge_results(path, named(generalization_rows(df, column, genes, alpha, todo)))
        except Exception:
            blank = {"status": F.lit("error"), "metric": F.lit(None).cast("string"), "value": F.lit(None).cast("double")}
            merge_results(path, named(todo.withColumn("stage", F.explode(F.array(*[F.lit(x) for x in STAGES]))).withColumns(blank)))
            raise
    return read_results(spark, path)


def result_table(results: DataFrame) -> DataFrame:
    """A metric column per stage, as the evaluation marts read them."""
    wide = [F.when(F.col("stage") == s, F.col("value")).alias(c) for s, c in METRICS.items()]
    return results.select("split_type", "heldout", slugify(F.col("heldout")).alias("task_slug"), "stage", "status", *wide, "run_name")
