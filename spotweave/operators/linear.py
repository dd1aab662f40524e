"""Ridge regression from sufficient statistics.

Everything a ridge fit needs is the matrix of cross products of [1, features] and, per target, the products with it. Tasks reduce
them from the rows batch by batch and hand them on as tiles, Spark adds the tiles up by a tree, and only the solve of a model, by Cholesky
factors with refinement, runs in one task. Leaving a group out is a subtraction of tiles, so the data is read once however many
models are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spotweave.functions.moments import metric_columns, pearson_of_sums, sum_pairs
from spotweave.functions.scalars import dot
from spotweave.operators.evaluate import gene_summary
from spotweave.operators.sfmetrics import METRICS, sf_metrics
from spotweave.operators.sizefactor import SPOT, normalise_predicted
from spotweave.session import materialise

TILE = 64  # a matrix travels as upper-triangle tiles of this many rows and columns
HELD_BYTES = 64 << 20  # of matrices in a task before it hands them on
FAN = 256  # parts added up at a time


def tree_sum(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Arrays of `value` added up per key, element by element, in two levels: tasks are dealt over `FAN` partial sums first, so no row
    collects the arrays of all tasks."""
    def added(d: DataFrame, by: list[str]) -> DataFrame:
        held = d.groupBy(*by).agg(F.collect_list(value).alias("_l"))
        rest = F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0)))
        return held.select(*by, F.aggregate(rest, F.col("_l")[0], lambda x, y: F.zip_with(x, y, lambda u, w: u + w)).alias(value))

    return added(added(parts.withColumn("_s", F.spark_partition_id() % FAN), [*keys, "_s"]), keys)


def _tiles(m: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for i in range(0, len(m), TILE):
        for j in range(i, len(m), TILE):
            yield i // TILE, j // TILE, m[i : i + TILE, j : j + TILE].ravel()


def _assembled(tiles: pd.DataFrame, column: str = "gram") -> np.ndarray:
    """The symmetric matrix of the tiles of one key. Tiles of the diagonal are square, so they tell the size."""
    size = {r.i: int(round(np.sqrt(len(getattr(r, column))))) for r in tiles.itertuples() if r.i == r.j}
    start = {i: sum(size[k] for k in size if k < i) for i in size}
    m = np.zeros((sum(size.values()),) * 2)
    for r in tiles.itertuples():
        block = np.asarray(getattr(r, column), dtype=np.float64).reshape(size[r.i], size[r.j])
        rows, cols = slice(start[r.i], start[r.i] + size[r.i]), slice(start[r.j], start[r.j] + size[r.j])
        m[rows, cols] = block
        m[cols, rows] = block.T
    return m


def cross_products(df: DataFrame, key: str, features: str = "features", targets: str = "targets") -> DataFrame:
    """(key, i, j, gram): tiles of the matrix of sums of products of [1, features…, targets…] per key.

    A task holds one matrix per key it meets, up to `HELD_BYTES` of them, and hands them on as tiles; equal tiles are added up by a tree.
    """
    d = df.select(F.col(key).cast("string").alias("key"), F.col(features).alias("x"), F.col(targets).alias("y"))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def handed_on() -> pd.DataFrame:
            rows = [(name, i, j, v) for name, m in held.items() for i, j, v in _tiles(m)]
            held.clear()
            return pd.DataFrame(rows, columns=["key", "i", "j", "gram"])

        for b in batches:
            if b.empty:
                continue
            z = np.hstack([np.ones((len(b), 1)), np.vstack(b["x"].to_numpy()), np.vstack(b["y"].to_numpy()).reshape(len(b), -1)]).astype(np.float64)
            codes, names = pd.factorize(b["key"], use_na_sentinel=False)
            for i, name in enumerate(names):
                part = z[codes == i]
                g = part.T @ part
                held[name] = held[name] + g if name in held else g
            if len(held) * z.shape[1] ** 2 * 8 > HELD_BYTES:
                yield handed_on()
        if held:
            yield handed_on()

    parts = d.mapInPandas(reduce, "key string, i int, j int, gram array<double>")
    return tree_sum(parts, ["key", "i", "j"], "gram").withColumnRenamed("key", key)


def total_products(grams: DataFrame) -> DataFrame:
    """The tiles summed over all keys."""
    return tree_sum(grams.select("i", "j", F.col("gram").alias("total")), ["i", "j"], "total")


def left_out(grams: DataFrame, key: str) -> DataFrame:
    """For every key the products of all other keys."""
    j = grams.join(total_products(grams), ["i", "j"])
    return j.select(key, "i", "j", F.zip_with("total", "gram", lambda t, g: t - g).alias("gram"))


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a·x = b by Cholesky factors, refined until the residual is small; the shortest solution where `a` is singular."""
    try:
        lower = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]
    back = lambda r: np.linalg.solve(lower.T, np.linalg.solve(lower, r))
    x = back(b)
    for _ in range(3):
        r = b - a @ x
        if np.linalg.norm(r) <= 1.0e-13 * np.linalg.norm(b):
            break
        x = x + back(r)
    return x


def solve_ridge(grams: DataFrame, key: str, n_targets: int = 1, alpha: float = 10.0) -> DataFrame:
    """(key, target, intercept, weights, n_train) on the scale of the raw features.

    Features are standardised by their own mean and spread of the training rows and the intercept is not penalised. A key's matrix is
    put together in one task: (1 + features + targets)² numbers.
    """

    def solve(key_: tuple, tiles: pd.DataFrame) -> pd.DataFrame:
        rows = []
        g = _assembled(tiles)
        v = g[len(g) - n_targets :, : len(g) - n_targets]
        b = _fit(g[: len(g) - n_targets, : len(g) - n_targets], v, alpha)
        if b is not None:
            rows = [(key_[0], t, float(b[t, 0]), b[t, 1:].tolist(), int(round(g[0, 0]))) for t in range(n_targets)]
        return pd.DataFrame(rows, columns=["key", "target", "intercept", "weights", "n_train"])

    schema = "key string, target int, intercept double, weights array<double>, n_train bigint"
    return grams.withColumnRenamed(key, "key").groupBy("key").applyInPandas(solve, schema).withColumnRenamed("key", key)


def score(df: DataFrame, models: DataFrame, keys: list[str], out: str = "prediction", features: str = "features") -> DataFrame:
    """Linear scores; each row takes the models of its key (all models without keys). Models are a row per target."""
    value: Column = F.col("intercept") + dot(F.col(features), F.col("weights"))
    j = df.join(models, keys) if keys else df.crossJoin(models)
    return j.withColumn(out, value).drop("intercept", "weights", "n_train")


def ridge_baseline(train: DataFrame, test: DataFrame, y: str = "y", alpha: float = 10.0) -> DataFrame:
    """Fit on train, predict test, compare as size factors."""
    fit = train.select(F.lit("all").alias("model"), "features", F.array(F.col(y).cast("double")).alias("targets"))
    models = materialise(solve_ridge(cross_products(fit, "model"), "model", 1, alpha)).drop("model", "target")
    scored = score(test, models, [], "pred_log_sf")
    return sf_metrics(scored.select("pred_log_sf", F.col(y).alias("true_log_sf")), []).select(
        F.lit("ridge").alias("baseline"), F.lit(alpha).alias("alpha"), "n_spots", *METRICS
    )


def constant_baseline(test: DataFrame, y: str = "y") -> DataFrame:
    d = test.select(F.lit(0.0).alias("pred_log_sf"), F.col(y).alias("true_log_sf"))
    return sf_metrics(d, []).select(F.lit("constant").alias("baseline"), F.lit(None).cast("double").alias("alpha"), "n_spots", *METRICS)


def baseline_table(train: DataFrame, test: DataFrame, y: str = "y", alpha: float = 10.0) -> DataFrame:
    return constant_baseline(test, y).unionByName(ridge_baseline(train, test, y, alpha))


TARGET_PARTS = 16  # parts the targets of a group are dealt over


def feature_products(df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(key, i, j, gram): tiles of the sums of products of [1, features…] per key, whatever the number of targets."""
    return cross_products(df.withColumn("_none", F.array().cast("array<double>")), key, features, "_none")


def target_products(rows: DataFrame, key: str) -> DataFrame:
    """(key, target, v): sums of y·[1, features…] and of y² from rows (key, target, y, features). Rows with y = 0 may be left out."""
    d = rows.select(F.col(key).cast("string").alias("key"), "target", F.col("y").cast("double").alias("y"), F.col("features").alias("x"))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            y = b["y"].to_numpy(np.float64)[:, None]
            z = np.hstack([y, np.vstack(b["x"].to_numpy()).astype(np.float64) * y, y * y])
            sums = pd.DataFrame(z).groupby([b["key"].to_numpy(), b["target"].to_numpy()], dropna=False).sum()
            yield pd.DataFrame({"key": sums.index.get_level_values(0), "target": sums.index.get_level_values(1), "v": list(sums.to_numpy())})

    parts = d.mapInPandas(reduce, "key string, target string, v array<double>")
    return tree_sum(parts, ["key", "target"], "v").withColumnRenamed("key", key)


def _fit(gram: np.ndarray, v: np.ndarray, alpha: float) -> np.ndarray | None:
    """Rows (intercept, weights…) per target: `gram` of [1, features…] over the training rows, `v` a row of y·[1, features…] per target."""
    n = gram[0, 0]
    if n < 2:
        return None
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
    std[std < 1.0e-12] = 1.0
    a = cov / np.outer(std, std) + alpha * np.eye(len(std))
    w = solve_spd(a, ((v[:, 1:] - np.outer(v[:, 0], mean)) / std).T).T / std
    return np.hstack([(v[:, 0] / n - w @ mean)[:, None], w])


def _only(df: DataFrame, group: str, heldouts: DataFrame | None) -> DataFrame:
    """Rows of the groups named in `heldouts` (column heldout); all rows without it."""
    return df if heldouts is None else df.join(heldouts.select(F.col("heldout").alias(group)), group, "left_semi")


def leave_group_out_models(df: DataFrame, targets: DataFrame, group: str, alpha: float = 10.0, heldouts: DataFrame | None = None) -> DataFrame:
    """A model per group and target, fitted on all other groups, with the sums of its predictions on the group left out.

    `df` has the group, SPOT and features; `targets` has SPOT, target and y, where rows with y = 0 may be missing. One pass reads the
    features and one the targets; a model is total minus group. The products of features and those with targets are separate, so the
    work per target is one row. With `heldouts` (column heldout) only these groups get models; all rows still count for training. Columns: group, target, intercept, weights, n_train and n, sp, st, spp, stt, spt on the group. A
    group without training rows has none. The result has groups × targets rows by its nature.
    """
    x = materialise(feature_products(df, group))
    y = materialise(target_products(df.select(*dict.fromkeys([group, *SPOT, "features"])).join(targets, SPOT), group))
    whole = tree_sum(y.select("target", F.col("v").alias("total")), ["target"], "total")
    mine = _only(x, group, heldouts)
    every = mine.select(F.col(group).alias("_g")).distinct().crossJoin(whole)  # a model per group and target is the result
    rows = every.join(y.withColumnRenamed(group, "_g"), ["_g", "target"], "left").withColumn("part", F.pmod(F.xxhash64("target"), F.lit(TARGET_PARTS)).cast("int"))
    both = mine.select(group, "i", "j", F.col("gram").alias("own")).join(left_out(x, group), [group, "i", "j"])
    both = both.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(TARGET_PARTS - 1))))
    schema = f"{group} string, target string, intercept double, weights array<double>, n_train bigint, n bigint, sp double, st double, spp double, stt double, spt double"

    def fit(key: tuple, grams: pd.DataFrame, targets_: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in schema.split(", ")})
        if grams.empty or targets_.empty:
            return none
        train, own = _assembled(grams), _assembled(grams, "own")
        total = np.vstack(targets_["total"].to_numpy()).astype(np.float64)
        mine = np.vstack([np.zeros(len(train) + 1) if v is None else np.asarray(v, dtype=np.float64) for v in targets_["v"]])
        b = _fit(train, (total - mine)[:, :-1], alpha)
        if b is None:
            return none
        xy = mine[:, :-1]
        return pd.DataFrame({
            group: key[0], "target": targets_["target"], "intercept": b[:, 0], "weights": list(b[:, 1:]), "n_train": int(round(train[0, 0])),
            "n": int(round(own[0, 0])), "sp": b @ own[0], "st": xy[:, 0], "spp": np.einsum("ij,jk,ik->i", b, own, b), "stt": mine[:, -1], "spt": (b * xy).sum(1),
        })

    return both.groupBy(group, "part").cogroup(rows.groupBy("_g", "part")).applyInPandas(fit, schema)


def leave_group_out_scores(df: DataFrame, targets: DataFrame, group: str, alpha: float = 10.0) -> DataFrame:
    """Every row scored by the models of its group, which were fitted on all other groups: SPOT, group, target, prediction, truth."""
    models = materialise(leave_group_out_models(df, targets, group, alpha)).select(group, "target", "intercept", "weights", "n_train")
    keyed = df.select(*dict.fromkeys([group, *SPOT, "features"])).withColumn(group, F.col(group).cast("string"))
    scored = score(keyed, models, [group]).drop("features")
    return scored.join(targets.select(*SPOT, "target", F.col("y").alias("truth")), [*SPOT, "target"], "left").withColumn("truth", F.coalesce("truth", F.lit(0.0)))


SF_TARGET = ""  # the name of the size-factor target beside the genes


def generalization_rows(df: DataFrame, group: str, genes: DataFrame, alpha: float = 10.0, heldouts: DataFrame | None = None) -> DataFrame:
    """Leave-group-out results as (heldout, stage, status, metric, value) for the stages sf, expression and combined.

    `df` has the group, SPOT, features and log_sf; `genes` has SPOT, target and y, the log1p rates that are not 0. Expression metrics
    come from sums. The combined stage multiplies predicted rates, cut at 0, with the predicted, mean-one size factor and compares
    counts; it is the only one that scores every row for every gene. A group without training rows gets a row with status missing_model.
    With `heldouts` (distinct labels as strings, column heldout) only these are fitted and returned; one that no row has gets status
    missing_rows.
    """
    sf_rows = df.select(*SPOT, F.lit(SF_TARGET).alias("target"), F.col("log_sf").cast("double").alias("y"))
    targets = materialise(sf_rows.unionByName(genes.select(*SPOT, "target", F.col("y").cast("double").alias("y"))))
    models = materialise(leave_group_out_models(df, targets, group, alpha, heldouts))
    keyed = df.select(*dict.fromkeys([group, *SPOT, "features", "log_sf"])).withColumn("_group", F.col(group).cast("string"))
    keyed = materialise(_only(keyed, "_group", heldouts))
    one_model = models.select(F.col(group).alias("_group"), "target", "intercept", "weights", "n_train")
    sf = score(keyed, one_model.filter(F.col("target") == SF_TARGET).drop("target"), ["_group"], "pred_log_sf").select(
        "_group", *SPOT, "pred_log_sf", F.col("log_sf").cast("double").alias("true_log_sf")
    )
    sf = materialise(sf)
    held = lambda d, stage, metric, value: d.select(F.col("_group").alias("heldout"), F.lit(stage).alias("stage"), F.lit(metric).alias("metric"), F.col(value).alias("value"))
    m = held(sf_metrics(sf, ["_group"]), "sf", "log_sf_pearson", "log_sf_pearson")
    by_gene = models.filter(F.col("target") != SF_TARGET).select(F.col(group).alias("_group"), pearson_of_sums().alias("pearson"))
    e = held(gene_summary(by_gene, ["_group"]), "expression", "mean_gene_pearson", "mean_gene_pearson")
    one = normalise_predicted(sf, "pred_log_sf", scope=["_group"]).select("_group", *SPOT, "pred_sf", F.exp("true_log_sf").alias("_sf"))
    dense = score(keyed.select("_group", *SPOT, "features"), one_model.filter(F.col("target") != SF_TARGET), ["_group"], "pred").drop("features")
    counts = dense.join(one, ["_group", *SPOT]).join(genes.select(*SPOT, "target", "y"), [*SPOT, "target"], "left")
    counts = counts.select(
        "_group", "target", (F.greatest(F.expm1("pred"), F.lit(0.0)) * F.col("pred_sf")).alias("pred"), (F.expm1(F.coalesce("y", F.lit(0.0))) * F.col("_sf")).alias("true"),
    )
    per_gene = sum_pairs(counts, ["_group", "target"]).select("_group", *metric_columns())
    c = held(gene_summary(per_gene, ["_group"]), "combined", "count_pred_sf_mean_gene_pearson", "mean_gene_pearson")
    rows = m.unionByName(e).unionByName(c)
    stages = F.explode(F.array(*[F.lit(x) for x in ("sf", "expression", "combined")])).alias("stage")
    have = keyed.select(F.col("_group").alias("heldout")).distinct().withColumn("_have", F.lit(True))
    tasks = (have if heldouts is None else heldouts.select("heldout").join(have, "heldout", "left")).select("heldout", "_have", stages)
    out = tasks.join(rows, ["heldout", "stage"], "left")
    status = F.when(F.col("_have").isNull(), "missing_rows").when(F.col("metric").isNull(), "missing_model").otherwise("ok")
    return out.select("heldout", "stage", status.alias("status"), "metric", "value")
