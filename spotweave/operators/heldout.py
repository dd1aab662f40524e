"""Leave-one-label-out tasks by label algebra, without a row per sample and task.

A task holds out one label; its test samples are those of the label and all others are for training, but for a few validation samples.
Sizes follow from counts per label. Names of the labels that are left in training are all names but those whose samples are used up by
test and validation. Only the validation picks, the lowest hash scores of a task, need to look at its samples; samples travel in blocks,
and a block gives back only scores that can be among the lowest.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotweave.functions.scalars import slugify
from spotweave.operators.marts import TASK, missing_assets
from spotweave.operators.sizefactor import SAMPLE
from spotweave.session import materialise

BLOCK_ROWS, LEAST_BLOCKS = 512, 4  # samples of a block
SLACK = 2.0  # scores are looked at up to this multiple of the share that is picked


def label_tasks(samples: DataFrame, columns: dict[str, str], least: dict[str, int] | None = None, fraction: float = 0.1) -> DataFrame:
    """(split_type, heldout, n_slides, n_train_slides, n_val_slides, n_test_slides), a row per label of the column of each split type.

    Labels with fewer samples than `least` of their split type have no task; samples without a label train in every task.
    """
    pairs = F.array(*[F.struct(F.lit(t).alias("split_type"), F.col(c).cast("string").alias("heldout"), F.lit((least or {}).get(t, 1)).alias("least")) for t, c in columns.items()])
    held = samples.select(F.explode(pairs).alias("p")).select("p.*").filter("heldout IS NOT NULL")
    held = held.groupBy(*TASK).agg(F.count(F.lit(1)).alias("n_test_slides"), F.max("least").alias("least")).filter("n_test_slides >= least")
    d = held.crossJoin(samples.agg(F.count(F.lit(1)).alias("n_slides")))  # one row
    rest = F.col("n_slides") - F.col("n_test_slides")
    n_val = F.least(F.greatest(F.lit(1), F.bround(rest.cast("double") * F.lit(fraction))), rest - 1).cast("long")
    n_val = F.when((rest >= 2) & F.lit(fraction > 0), n_val).otherwise(F.lit(0).cast("long"))
    return d.select(*TASK, "n_slides", (rest - n_val).alias("n_train_slides"), n_val.alias("n_val_slides"), "n_test_slides")


def validation_picks(samples: DataFrame, tasks: DataFrame, columns: dict[str, str], seed: int = 2026, slack: float = SLACK) -> DataFrame:
    """(split_type, heldout, sample_id): the `n_val_slides` training samples of lowest hash score per task, ties by id.

    The score is that of `functions.scalars.stable_score`; a block of samples meets all tasks in one Python call, where a hash is many
    times cheaper than in a nested column expression. Scores up to `slack` times the share to pick are ranked. A task that finds too few
    there, which hash scores make all but impossible, is ranked again over all its samples, so the result is exact.
    """
    labels = [F.col(c).cast("string").alias(t) for t, c in columns.items()]
    n = max(LEAST_BLOCKS, samples.count() // BLOCK_ROWS)
    members = samples.select(F.pmod(F.xxhash64(SAMPLE), F.lit(n)).cast("int").alias("block"), F.col(SAMPLE).cast("string").alias(SAMPLE), *labels)
    members = members.repartition(n, "block").groupBy("block")  # a fixed number of partitions: small tables, much work

    def scores(tasks_: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        ids = [i.encode() for i in rows[SAMPLE]]
        for t in tasks_.itertuples():
            start = hashlib.sha1(f"{seed}|{t.split_type}:{t.heldout}|".encode())
            own = rows[t.split_type].to_numpy()
            for k, i in enumerate(ids):
                if own[k] == t.heldout:
                    continue
                h = start.copy()
                h.update(i)
                score = h.hexdigest()
                if score[:8] <= t.cut:
                    out.append((t.split_type, t.heldout, t.n_val_slides, score, rows[SAMPLE].iat[k]))
        return pd.DataFrame(out, columns=[*TASK, "n_val_slides", "score", SAMPLE])

    def lowest(of: DataFrame, share: Column) -> DataFrame:
        cut = F.lower(F.lpad(F.hex(F.floor(F.least(share, F.lit(1.0)) * 4294967295.0).cast("long")), 8, "0"))
        d = of.select(*TASK, "n_val_slides", cut.alias("cut"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
        d = d.repartition(n, "block").groupBy("block").cogroup(members).applyInPandas(scores, f"split_type string, heldout string, n_val_slides long, score string, {SAMPLE} string")
        rank = F.row_number().over(Window.partitionBy(*TASK).orderBy("score", SAMPLE))
        return d.withColumn("_r", rank).filter("_r <= n_val_slides").select(*TASK, SAMPLE)

    wanted = tasks.filter("n_val_slides > 0")
    share = F.lit(slack) * F.col("n_val_slides") / (F.col("n_train_slides") + F.col("n_val_slides"))
    picked = materialise(lowest(wanted, share))
    got = picked.groupBy(*TASK).agg(F.count(F.lit(1)).alias("_got"))
    short = wanted.join(got, TASK, "left").filter(F.coalesce("_got", F.lit(0)) < F.col("n_val_slides")).drop("_got")
    if short.isEmpty():
        return picked
    short = materialise(short)
    return picked.join(short, TASK, "left_anti").unionByName(lowest(short, F.lit(1.0)))


NAMES = ("organ", "cohort")


def _names(samples: DataFrame, tasks: DataFrame, picks: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per task the organs and cohorts among its training and its test samples, joined by bars."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("v")) for n in NAMES])).alias("p")
    held = F.array(*[F.struct(F.lit(t).alias("split_type"), F.col(c).cast("string").alias("heldout")) for t, c in columns.items()])
    long = samples.select(SAMPLE, held.alias("held"), named).select(SAMPLE, "held", "p.*").filter("v IS NOT NULL")
    totals = long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("total"))
    test = long.select(F.explode("held").alias("t"), "name", "v").select("t.*", "name", "v", F.lit(1).alias("test"))
    val = picks.join(long.select(SAMPLE, "name", "v").hint("merge"), SAMPLE).select(*TASK, "name", "v", F.lit(0).alias("test"))
    used = test.unionByName(val).groupBy(*TASK, "name", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("test").alias("n_test")).join(totals, ["name", "v"])
    pick = lambda n, condition: F.collect_list(F.when((F.col("name") == n) & condition, F.col("v")))
    lists = used.groupBy(*TASK).agg(
        *[pick(n, F.col("n") == F.col("total")).alias(f"gone_{n}") for n in NAMES],
        *[F.array_join(F.array_sort(pick(n, F.col("n_test") > 0)), "|").alias(f"test_{n}s") for n in NAMES],
    )
    every = totals.agg(*[F.array_sort(F.collect_list(F.when(F.col("name") == n, F.col("v")))).alias(f"all_{n}") for n in NAMES])  # one row of names
    d = tasks.join(lists, TASK, "left").crossJoin(every)
    none = F.array().cast("array<string>")
    train = [F.array_join(F.array_except(f"all_{n}", F.coalesce(f"gone_{n}", none)), "|").alias(f"train_{n}s") for n in NAMES]
    return d.select(*tasks.columns, *train, *[F.coalesce(f"test_{n}s", F.lit("")).alias(f"test_{n}s") for n in NAMES])


def summary(samples: DataFrame, tasks: DataFrame, columns: dict[str, str], seed: int = 2026) -> DataFrame:
    """The columns of `marts.task_summary` for the tasks of `label_tasks`."""
    picks = validation_picks(samples, tasks, columns, seed)
    d = _names(samples, tasks, picks, columns)
    full = (F.col("n_train_slides") > 0) & (F.col("n_val_slides") > 0) & (F.col("n_test_slides") > 0)
    return d.withColumn("has_train_val_test", full).withColumn("task_slug", slugify(F.col("heldout")))


def assets_of_all(samples: DataFrame, tasks: DataFrame, assets: DataFrame) -> DataFrame:
    """The columns of `marts.missing_assets`: every sample is in every one of these tasks, so all have the same counts and examples."""
    whole = missing_assets(samples.select(F.lit("").alias("split_type"), F.lit("").alias("heldout"), SAMPLE), assets).drop(*TASK)
    return tasks.select(*TASK).crossJoin(whole)  # one row, none without assets
