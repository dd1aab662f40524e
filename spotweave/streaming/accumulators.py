"""The metric accumulators over a stream of (pred, true) rows.

Power sums per (sample, gene) are the state of a streaming aggregate in a RocksDB state store, so its size follows the keys, not the
triggers. A trigger hands on the totals of the keys it touched, and these replace the totals of the same keys in a table that is dealt over
a fixed number of buckets; only touched buckets are rewritten. Totals replace totals, so a trigger that runs again after a failure
changes nothing. Finishing the sums is the same code as in batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from spotweave.functions.moments import merged_sums, metric_columns, sum_pairs
from spotweave.sources.tables import scratch_path

KEYS = ["sample_id", "gene"]
BUCKETS = 16
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_pairs_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def accumulate(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Works on streams and on batches alike."""
    return sum_pairs(pairs, keys or KEYS)


def with_labels(pairs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """The stream with label columns of a static table of samples; rows of unknown samples keep null labels."""
    one = labels.groupBy("sample_id").agg(*[F.min(c).alias(c) for c in columns])
    return pairs.join(one, "sample_id", "left")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB for the queries started inside; a running query keeps the settings it was started with."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def merge_totals(out: str, totals: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
    """`totals` replace the rows of their keys (null is a key like others) in the table at `out`; other buckets are not touched."""
    spark = totals.sparkSession
    new = totals.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        if new.isEmpty():
            return
        try:
            old = spark.read.schema(new.schema).parquet(out).alias("o")
            same = reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ["bucket", *keys]])
            old = old.join(new.select("bucket").distinct(), "bucket", "left_semi").alias("o").join(new.alias("n"), same, "left_anti").select(*new.columns)
            rows = old.unionByName(new)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = new
        rows.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
    finally:
        new.unpersist()


def run_to_end(pairs: DataFrame, out: str, checkpoint: str, keys: list[str] | None = None) -> str:
    """Process what the source holds and stop. Returns the folder of totals. A later call with the same folders goes on from there."""
    spark, keys = pairs.sparkSession, keys or KEYS
    with _state_store(spark):
        q = (
            accumulate(pairs, keys).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, _: merge_totals(out, batch, keys)).start()
        )
        q.awaitTermination()
    return out


def accumulate_stream(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Power sums per key over all the source holds, a row per key."""
    spark = pairs.sparkSession
    out = run_to_end(pairs, scratch_path(spark, "stream-sums"), scratch_path(spark, "stream-checkpoint"), keys)
    return spark.read.parquet(out).drop("bucket")


def gene_metrics_of(state: DataFrame) -> DataFrame:
    return state.groupBy("gene").agg(*merged_sums()).select("gene", *metric_columns("n_obs", detected=True))


def level_metrics_of(state: DataFrame) -> DataFrame:
    """Overall, per gene and per sample from the same state, and per organ if its rows carry one; rows without an organ have no such level."""
    by = [c for c in ("gene", "sample_id", "organ") if c in state.columns]
    rolled = state.groupingSets([[], *[[c] for c in by]], *by).agg(*merged_sums(), *[F.grouping(c).alias(f"_{c}") for c in by])
    level = F.lit("overall")
    for c, name in (("gene", "gene"), ("sample_id", "slide"), ("organ", "organ")):
        level = F.when(F.col(f"_{c}") == 0, name).otherwise(level) if c in by else level
    kept = rolled.filter("_organ = 1 OR organ IS NOT NULL") if "organ" in by else rolled
    return kept.select(level.alias("level"), *by, *metric_columns("n_values"))
