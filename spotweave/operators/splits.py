"""Leakage-safe splits, folds and tasks. Random choices are hash orders, equal on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.checks import require_columns
from spotweave.functions.scalars import slugify, stable_score
from spotweave.operators.ordering import row_number
from spotweave.operators.sizefactor import SAMPLE, with_group_stats

COLUMNS = [SAMPLE, "split", "split_type", "heldout"]


def leave_slide_out(samples: DataFrame, seed: int = 2026, train: float = 0.70, val: float = 0.10, test: float = 0.20) -> DataFrame:
    """Train/val/test per organ in the given shares; organs of three or more always keep a val and a test sample."""
    if abs(train + val + test - 1.0) > 1.0e-8:
        raise ValueError("the three shares must add up to 1")
    d = samples.select(SAMPLE, F.coalesce("organ", F.lit("")).alias("organ"))
    d = with_group_stats(d, ["organ"], F.count(F.lit(1)).alias("_n"))
    d = row_number(d, ["organ"], [stable_score(seed, F.col("organ"), F.col(SAMPLE)), F.col(SAMPLE)], "_r")
    n = F.col("_n")
    n_train = F.bround(n.cast("double") * F.lit(train))
    n_val = F.bround(n.cast("double") * F.lit(val))
    tight = (n_train + n_val >= n) & (n >= 3)
    n_train, n_val = F.when(tight, F.greatest(F.lit(1), n - 2)).otherwise(n_train), F.when(tight, F.lit(1)).otherwise(n_val)
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "val").otherwise("test")
    return d.select(SAMPLE, split.alias("split"), F.lit("leave_slide_out").alias("split_type"), F.lit("").alias("heldout"))


def _heldout_grid(samples: DataFrame, column: str, heldouts: DataFrame, split_type: str) -> DataFrame:
    """Every sample once per held-out value; the number of values is that of the labels, and so is the output."""
    grid = samples.select(SAMPLE, F.col(column).alias("_value")).crossJoin(heldouts.select("heldout"))
    split = F.when(F.col("_value") == F.col("heldout"), "test").otherwise("train")
    return grid.select(SAMPLE, split.alias("split"), F.lit(split_type).alias("split_type"), "heldout")


def leave_organ_out(samples: DataFrame, organs: list[str] | None = None) -> DataFrame:
    held = samples.filter("organ IS NOT NULL").select(F.col("organ").alias("heldout")).distinct()
    return _heldout_grid(samples, "organ", held.filter(F.col("heldout").isin(organs)) if organs else held, "leave_organ_out")


def leave_cohort_out(samples: DataFrame, column: str = "cohort", min_test_slides: int = 5) -> DataFrame:
    held = samples.groupBy(F.col(column).alias("heldout")).count().filter((F.col("count") >= min_test_slides) & F.col("heldout").isNotNull())
    return _heldout_grid(samples, column, held, "leave_cohort_out")


def group_splits(df: DataFrame, group_col: str, train: float = 0.7, val: float = 0.15, seed: int = 2026) -> DataFrame:
    """Whole groups go to one split; the shares count groups."""
    require_columns(df, [group_col])
    if not (0 < train < 1 and 0 < val < 1 and train + val < 1):
        raise ValueError("train and val must be positive and leave room for test")
    g = df.select(F.col(group_col).cast("string").alias("_g")).distinct()
    g = row_number(g, [], [stable_score(seed, F.col("_g")), F.col("_g")], "_r")
    g = with_group_stats(g, [], F.count(F.lit(1)).alias("_n"))
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_val = F.floor((F.col("_n") - n_train) * F.lit(val / (1.0 - train)) + F.lit(1.0e-9))
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "val").otherwise("test")
    return df.drop("split").join(g.select(F.col("_g"), split.alias("split")), F.col(group_col).cast("string") == F.col("_g")).drop("_g")


def group_folds(df: DataFrame, group_col: str, n_splits: int) -> DataFrame:
    """Fold per group, near-equal in rows: groups by size, largest first, dealt forth and back over the folds."""
    require_columns(df, [group_col])
    g = df.groupBy(F.col(group_col).cast("string").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    g = row_number(g, [], [-F.col("_n"), F.col("_g")], "_r")
    i, k = F.col("_r") - 1, F.lit(n_splits)
    within = i % k
    fold = F.when(F.floor(i / k) % 2 == 0, within).otherwise(k - 1 - within)
    return df.join(g.select("_g", fold.cast("int").alias("fold")), F.col(group_col).cast("string") == F.col("_g")).drop("_g")


def fold_lists(folds: DataFrame, n_splits: int) -> DataFrame:
    """(fold, role, sample_id): out-of-fold members and the training samples of every fold, as rows."""
    roles = F.transform(
        F.sequence(F.lit(0), F.lit(n_splits - 1)),
        lambda f: F.struct(f.alias("fold"), F.when(f == F.col("own"), "oof").otherwise("train").alias("role")),
    )
    d = folds.select(SAMPLE, F.col("fold").alias("own")).distinct()
    return d.select(SAMPLE, F.explode(roles).alias("r")).select("r.fold", "r.role", SAMPLE)


def add_validation(tasks: DataFrame, seed: int = 2026, fraction: float = 0.1, keys: list[str] | None = None) -> DataFrame:
    """Carve validation samples out of train, for every task that has none: the lowest hash scores.

    `tasks` is long: one row per (task keys, sample). The scored text is `seed|split_type:heldout|sample_id`.
    """
    keys = keys or ["split_type", "heldout"]
    n = lambda s: F.count(F.when(F.col("split") == s, 1))
    d = with_group_stats(tasks, keys, n("train").alias("_train"), n("val").alias("_val"))
    n_val = F.least(F.greatest(F.lit(1), F.bround(F.col("_train").cast("double") * F.lit(fraction))), F.col("_train") - 1)
    need = (F.col("_val") == 0) & (F.col("_train") >= 2) & F.lit(fraction > 0)
    score = stable_score(seed, F.concat("split_type", F.lit(":"), "heldout"), F.col(SAMPLE))
    d = d.withColumn("_train_row", (F.col("split") == "train").cast("int")).withColumn("_score", score)
    d = row_number(d, [*keys, "_train_row"], [F.col("_score"), F.col(SAMPLE)], "_r")
    pick = need & (F.col("_train_row") == 1) & (F.col("_r") <= n_val)
    return d.withColumn("split", F.when(pick, "val").otherwise(F.col("split"))).drop("_train", "_val", "_train_row", "_score", "_r")


def enumerate_tasks(split_table: DataFrame) -> DataFrame:
    """One task per held-out value; a single one for leave_slide_out."""
    single = F.col("split_type") == "leave_slide_out"
    held = F.when(single, F.col("split_type")).otherwise(F.coalesce("heldout", F.lit("nan")))
    return split_table.groupBy("split_type", held.alias("heldout")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "task_slug", slugify(F.col("heldout"))
    )


def task_samples(samples: DataFrame, split_table: DataFrame, seed: int = 2026, fraction: float = 0.1) -> DataFrame:
    """Samples of every task with their labels and split: one row of a repeated sample, unmatched samples left out."""
    single = F.col("split_type") == "leave_slide_out"
    t = split_table.withColumn("heldout", F.when(single, F.col("split_type")).otherwise(F.col("heldout")))
    one = t.groupBy("split_type", "heldout", SAMPLE).agg(F.min("split").alias("split"))
    return add_validation(samples.drop("split").join(one.hint("merge"), SAMPLE), seed, fraction)


def balanced_weights(spots: DataFrame) -> DataFrame:
    """Sampling weight 1 / (rows of the sample)."""
    return with_group_stats(spots, [SAMPLE], F.count(F.lit(1)).alias("_n")).withColumn("weight", F.lit(1.0) / F.col("_n")).drop("_n")


def hash_uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the SHA-1 of the seeded key; the same on any engine."""
    hexed = F.substring(stable_score(seed, *key), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(4294967296.0)


def balanced_draws(rows: DataFrame, key: list[str], draws: int, seed: int = 2026) -> DataFrame:
    """How often each row is drawn in exactly `draws` draws with replacement, every sample with the same chance.

    Draw i takes a sample by one hash uniform and a row inside it by another: two equi-joins on numbers, and only the rows drawn are
    counted. Rows never drawn have 0; rows of a null sample are a sample of their own.
    """
    d = rows.withColumn("_s", F.coalesce(F.col(SAMPLE), F.lit("")))
    d = row_number(d, ["_s"], [F.col(c) for c in key], "_row")
    sizes = row_number(d.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")), [], [F.col("_s")], "_no")
    sizes = with_group_stats(sizes, [], F.count(F.lit(1)).alias("_samples"))
    total = sizes.select(F.col("_samples").alias("_all")).limit(1)
    drawn = rows.sparkSession.range(draws).select(hash_uniform(seed, F.lit("sample"), F.col("id")).alias("_u"), hash_uniform(seed, F.lit("row"), F.col("id")).alias("_v"))
    drawn = drawn.crossJoin(total).select((F.floor(F.col("_u") * F.col("_all")) + 1).alias("_no"), "_v")  # one row on the right
    drawn = drawn.join(sizes.select("_no", "_s", "_n"), "_no").select("_s", (F.floor(F.col("_v") * F.col("_n")) + 1).alias("_row"))
    times = drawn.groupBy("_s", "_row").agg(F.count(F.lit(1)).alias("draws"))
    return d.join(times, ["_s", "_row"], "left").withColumn("draws", F.coalesce("draws", F.lit(0)).cast("long")).drop("_s", "_row")


def fit_subset(df: DataFrame, key: list[str], n: int, seed: int = 2026) -> DataFrame:
    """At most n rows, without replacement, by lowest hash."""
    return df.orderBy(stable_score(seed, *[F.col(c) for c in key]), *key).limit(n)
