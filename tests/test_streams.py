"""The streaming accumulators: restarts, repeated triggers, and state that follows the keys."""

import glob
import math

from spotweave.functions.moments import sum_pairs
from spotweave.streaming import accumulators


def rows(lo, hi):
    return [(f"s{i % 4}" if i % 9 else None, f"g{i % 3}", float(i % 7), float(i * i % 11) if i % 5 else math.nan) for i in range(lo, hi)]


SCHEMA = "sample_id string, gene string, pred double, true double"


def result(df):
    return sorted((str(r.level), str(r.gene), str(r.sample_id), str(r.organ), r.n_values, None if r.pearson is None else round(r.pearson, 9)) for r in df.collect())


def test_a_stream_that_stops_and_goes_on_gives_the_batch_answer(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    labels = spark.createDataFrame([("s0", "lung"), ("s1", "lung"), ("s2", "skin"), ("s2", "skin")], "sample_id string, organ string")
    keys = [*accumulators.KEYS, "organ"]
    sizes = []
    for lo, hi in ((0, 40), (40, 41), (41, 120)):
        spark.createDataFrame(rows(lo, hi), SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = accumulators.read_pairs_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
        accumulators.run_to_end(accumulators.with_labels(stream, labels, ["organ"]), out, check, keys)
        sizes.append(spark.read.parquet(out).count())
    state = spark.read.parquet(out).drop("bucket")
    batch = sum_pairs(accumulators.with_labels(spark.createDataFrame(rows(0, 120), SCHEMA), labels, ["organ"]), keys)
    assert result(accumulators.level_metrics_of(state)) == result(accumulators.level_metrics_of(batch))
    assert {r.level for r in accumulators.level_metrics_of(state).collect()} == {"overall", "gene", "slide", "organ"}
    assert sizes[-1] == batch.count() and len(glob.glob(f"{out}/bucket=*")) <= accumulators.BUCKETS
    accumulators.merge_totals(out, batch.limit(5), keys)  # a trigger that runs again
    assert result(accumulators.level_metrics_of(spark.read.parquet(out))) == result(accumulators.level_metrics_of(batch))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
