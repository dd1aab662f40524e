"""Operator 11: hard negatives by exact integer scores from Kronecker-packed products.

Components become integers, floor(256 x). Several candidates share one wide integer per component: each candidate is shifted to be
non-negative and sits in a field of its own, wide enough for the whole inner product. One product per anchor component then serves all
candidates of the word, and shifts and masks take the exact scores out again. Words of 53 bits are held as whole-number doubles, which
the matrix product of numpy adds exactly; wider fields use Python integers.

Anchors and candidates are cut into blocks of bounded size, by hash. Every pair of blocks is one unit of work; a task keeps only the
best few candidates per anchor. Nothing goes through the driver but the counts of rows, and nothing is broadcast by force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from spotweave.checks import InputError
from spotweave.llm.common import bounded_batches
from spotweave.session import materialise

WORD_BITS = 53  # whole numbers that a double holds exactly
WIDE_FIELDS = 8  # candidates in one Python integer
MOST_ROWS, LEAST_ROWS = 16_384, 1_024  # candidates of a block
MOST_ANCHORS = 2_048  # anchors of a block
SLICE = 2_000_000  # scores held at a time


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, label, embedding) without null labels and vectors and without null or non-finite components."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", "label", "embedding").filter(F.col("label").isNotNull() & x.isNotNull() & ~odd).distinct()


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as 64-bit integers, (anchors × candidates)."""
    shift_a, shift_c = max(0, -int(anchors.min(initial=0))), max(0, -int(candidates.min(initial=0)))
    d = anchors.shape[1]
    most = d * (int(anchors.max(initial=0)) + shift_a) * (int(candidates.max(initial=0)) + shift_c)
    width = max(1, most.bit_length())
    narrow = width <= WORD_BITS
    fields = WORD_BITS // width if narrow else WIDE_FIELDS
    if not narrow:
        whole = np.frompyfunc(int, 1, 1)
        anchors, candidates = whole(anchors).astype(object), whole(candidates).astype(object)
    a, c = anchors + shift_a, candidates + shift_c
    n = len(c)
    c = np.concatenate([c, np.zeros((-n % fields, d), dtype=c.dtype)]).reshape(-1, fields, d)
    word = sum(c[:, j, :] * (2 ** (width * j)) for j in range(fields))
    product = a @ word.T  # one multiplication per anchor component and word
    if narrow:
        product = product.astype(np.int64)
    mask = (1 << width) - 1
    out = np.empty((len(a), c.shape[0] * fields), dtype=product.dtype)
    for j in range(fields):
        out[:, j::fields] = (product >> (width * j)) & mask
    kind = np.int64 if narrow else object
    sums = lambda m: m.sum(axis=1).astype(kind)
    out = out[:, :n] - (shift_c * sums(a))[:, None] - (shift_a * sums(candidates + shift_c))[None, :] + d * shift_a * shift_c
    if not narrow and out.size and max(abs(int(out.max())), abs(int(out.min()))) >= 2**63:
        raise InputError("scores of these vectors do not fit 64 bits")
    return out.astype(np.int64)


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """By id, rows without one last."""
    return rows.sort_values("vec_id", na_position="last", kind="stable")


def _blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """A row per block: ids (with their nulls), labels and the components, in the order of ids."""
    dtype = "f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "f8"

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = _ordered(g)
        none = g["none"].to_numpy(bool)
        lengths = g["embedding"].map(len).to_numpy()
        x = np.zeros((len(g), int(lengths.max(initial=0))), dtype=dtype)
        for i, v in enumerate(g["embedding"]):
            x[i, : len(v)] = v
        ids, labels = g["id"].to_numpy(np.int64), g["label"].to_numpy(np.int64)
        return pd.DataFrame([(int(key[0]), ids.tobytes(), none.tobytes(), labels.tobytes(), x.tobytes(), x.shape[1])], columns=["block", "ids", "none", "labels", "x", "d"])

    d = rows.select(
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int").alias("block"), F.col("vec_id").isNull().alias("none"), "vec_id",
        F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("id"), F.col("label").cast("long").alias("label"), "embedding",
    )
    out = d.groupBy("block").applyInPandas(pack, "block int, ids binary, none binary, labels binary, x binary, d int")
    return out.select(F.col("block").alias(name), F.struct("ids", "none", "labels", "x", "d").alias(f"{name}_rows"))


def _unpack(block: dict, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, none, labels = (np.frombuffer(block[k], dtype=t) for k, t in (("ids", np.int64), ("none", bool), ("labels", np.int64)))
    x = np.frombuffer(block["x"], dtype=dtype).reshape(len(ids), block["d"]).astype(np.float64)
    return ids, none, labels, np.floor(256.0 * x)


def _padded(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of other lengths: missing components are 0."""
    d = max(a.shape[1], c.shape[1], 1)
    return tuple(m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (a, c))


def _sliced_scores(a: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor, its scores), a bounded number of scores at a time."""
    step = max(1, SLICE // max(1, len(c)))
    for at in range(0, len(a), step):
        for k, row in enumerate(packed_products(a[at : at + step], c)):
            yield at + k, row


def _highest(s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest values, the earlier first among equals."""
    idx = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
    return idx[np.argsort(-s[idx], kind="stable")][:k]


FOUND = ["i", "rank", "id", "none", "score"]


def _best_positives(cell, dtype: str, k: int) -> list[tuple]:
    ids, none, labels, a = _unpack(cell.a_rows, dtype)
    c_ids, c_none, c_labels, c = _unpack(cell.b_rows, dtype)
    a, c = _padded(a, c)
    out = []
    for label in np.intersect1d(labels, c_labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(c_labels == label)
        for at, s in _sliced_scores(a[mine], c[theirs]):
            i = mine[at]
            where = theirs
            own = (c_ids[theirs] == ids[i]) & ~c_none[theirs] & (not none[i])
            if own.any():
                where, s = theirs[~own], s[~own]
            top = _highest(s, k)
            out += [(i, 0, c_ids[where[j]], c_none[where[j]], s[j]) for j in top]
    return out


def _best_negatives(cell, dtype: str, k: int, low: int, high: int) -> list[tuple]:
    ids, none, labels, a = _unpack(cell.a_rows, dtype)
    c_ids, c_none, c_labels, c = _unpack(cell.b_rows, dtype)
    a, c = _padded(a, c)
    bounds: dict[int, list] = {}
    edge = 2**63 - 1
    for t in cell.targets:
        p = int(t["score"])
        lo, hi = -((-low * p) // 100), (high * p) // 100  # whole numbers between low and high hundredths of p
        if lo <= hi:
            bounds.setdefault(t["i"], []).append((t["rank"], max(lo, -edge), min(hi, edge)))
    at_all = np.array(sorted(bounds), dtype=np.int64)
    out = []
    for at, s in _sliced_scores(a[at_all], c):
        i = at_all[at]
        lows, highs = min(b[1] for b in bounds[i]), max(b[2] for b in bounds[i])
        idx = np.flatnonzero((s >= lows) & (s <= highs) & (c_labels != labels[i]))
        if not len(idx):
            continue
        idx = idx[np.argsort(-s[idx], kind="stable")]
        falling = -s[idx]
        for rank, lo, hi in bounds[i]:
            start = np.searchsorted(falling, -hi, "left")
            out += [(i, rank, c_ids[j], c_none[j], s[j]) for j in idx[start : start + k] if s[j] >= lo]
    return out


def _over_cells(cells: DataFrame, best: Callable, dtype: str, k: int) -> DataFrame:
    """Runs `best` over cells that come block of anchors by block of anchors; keeps the best k per (anchor, rank) of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current, own = pd.DataFrame(columns=FOUND), None, None

        def done() -> pd.DataFrame:
            i = held["i"].to_numpy(np.int64)
            ids = held["id"].astype("Int64").mask(held["none"].astype(bool)).array
            named = pd.Series(own[0][i]).astype("Int64").mask(own[1][i]).array
            return pd.DataFrame({"a": np.full(len(i), current), "i": i, "anchor_id": named, "rank": held["rank"].to_numpy(np.int64), "id": ids, "score": held["score"].to_numpy(np.int64)})

        for b in batches:
            for cell in b.itertuples():
                if cell.a != current and current is not None:
                    yield done()
                    held = held.iloc[:0]
                if cell.a != current:
                    current, own = cell.a, _unpack(cell.a_rows, dtype)[:2]
                new = pd.DataFrame(best(cell), columns=FOUND).astype({"i": "int64", "rank": "int64", "id": "int64", "none": bool, "score": "int64"})
                both = pd.concat([held, new], ignore_index=True) if len(held) else new
                both = both.iloc[np.lexsort((both["id"], both["none"], -both["score"], both["rank"], both["i"]))]
                held = both[both.groupby(["i", "rank"]).cumcount() < k]
        if current is not None:
            yield done()

    found = bounded_batches(cells, 4).mapInPandas(run, "a int, i int, anchor_id long, rank int, id long, score long")
    w = Window.partitionBy("a", "i", "rank").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and embedding; other columns, whatever their names, do not take part. Anchors are the usable rows (see
    `usable`) that the condition `anchors` holds for. The positives of an anchor are its `n_positives` best other rows of the same label;
    per positive the `n_negatives` best rows of other labels are returned whose score lies between `low` and `high` hundredths of the
    positive's. Higher scores come first, ties by smaller id, a row without an id last. Rows alike in id, label and vector count once;
    other rows of the anchor's id are the anchor itself and no positives of it. Anchors with different vectors under one id are judged
    one by one. Vectors of different lengths: missing components are 0. Empty tables and anchors without positives give no rows.

    Work is anchors × rows, in pairs of blocks. Scores beyond 64 bits are an error.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors))
    chosen = rows.filter(anchors)
    n, m = (int(v or 0) for v in rows.agg(F.count(F.lit(1)), F.count(F.when(anchors, 1))).first())
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = min(MOST_ROWS, max(LEAST_ROWS, -(-n // tasks)))  # more rows a block: less is sent; fewer: more tasks. The result is the same
    q, p = max(1, -(-n // per)), max(1, -(-m // MOST_ANCHORS))
    parts = min(p * q, max(tasks, p * q // 16))
    dtype = "f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "f8"
    a = materialise(_blocks(chosen, p, "a"))
    b = materialise(_blocks(rows, q, "b"))

    def cells(left: DataFrame) -> DataFrame:
        pairs = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(q - 1)))).repartition(parts, "a", "b")
        other = b.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).repartition(parts, "a", "b")
        return pairs.join(other, ["a", "b"]).sortWithinPartitions("a")

    positives = materialise(_over_cells(cells(a), lambda cell: _best_positives(cell, dtype, n_positives), dtype, n_positives).select(
        "a", "i", "anchor_id", F.col("place").alias("rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    targets = positives.groupBy("a").agg(F.collect_list(F.struct("i", "rank", F.col("positive_score").alias("score"))).alias("targets"))  # a block's anchors
    found = _over_cells(cells(a.join(targets, "a")), lambda cell: _best_negatives(cell, dtype, n_negatives, low, high), dtype, n_negatives)
    return found.drop("anchor_id").join(positives, ["a", "i", "rank"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )



ORACLE = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY rank <= 3
"""
