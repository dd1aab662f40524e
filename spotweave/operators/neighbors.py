"""Exact k nearest neighbours within groups, by a grid that grows where it has to.

Points are binned into square cells; a point meets the candidates of its 3×3 block. Anything closer than one cell width is certain
to be in the block, so a point is done once its k-th neighbour is that close. The others go on with wider cells.

The first width follows the density the points of a group live in, not their bounding box: the widest of a ladder of widths at which
the cell of an average point holds few places. Far outliers therefore do not widen the cells of a dense clump. Once few points are
left, they are compared with their whole group in one pass, each task keeping its k nearest only. In later rounds the candidates of a
crowded cell are dealt over salts, so no cell is a hot key.

Groups of a few points skip the grid: their points are compared inside one expression. Points at the same place are folded first:
whoever looks at a place needs at most the k + 1 lowest ids there, so a pile of coincident points costs no more than a few.

Points on a lattice take few bytes a row in a file and many in memory, and a block meets nine times the rows that the planner sees. So
joins of points with points are merge joins by a hint: chosen by file size, they would pass through the driver as broadcasts. For the
same reason the number of tasks follows the number of places: chosen by size, one task would sort the blocks of very many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.checks import InputError
from spotweave.operators.sizefactor import with_named_stats
from spotweave.session import materialise

SMALL = 16
LADDER = 20  # widths from the span of the group down by factors of four
GROWTH = [1, 2, 4] + [4**i for i in range(2, LADDER + 2)]  # of the first width, by round; the last covers any group
FEW = 256  # points that may be broadcast and compared with their whole group
SALTS = 8
PLACES_PER_TASK = 5_000  # each meets the few hundred candidates of its block, which its task sorts


def invalid_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """How many points per group have no finite place; `knn` leaves them out."""
    bad = ~(_finite("x") & _finite("y"))
    return points.groupBy(*keys).agg(F.count(F.when(bad, 1)).alias("n_invalid"))


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def _nearest_of_all(queries: DataFrame, reps: DataFrame, keys: list[str], need: int) -> DataFrame:
    """As `_nearest_of_block` for at most FEW places, against all representatives of their groups."""
    cand = reps.select(*keys, F.col("_x").alias("_nx"), F.col("_y").alias("_ny"), "_rep")
    d2 = (F.col("_x") - F.col("_nx")) * (F.col("_x") - F.col("_nx")) + (F.col("_y") - F.col("_ny")) * (F.col("_y") - F.col("_ny"))
    met = cand.join(F.broadcast(queries.select(*keys, "_x", "_y")), keys).select(*keys, "_x", "_y", "_rep", d2.alias("_d2"))
    order = W.partitionBy(*keys, "_x", "_y").orderBy("_d2", "_rep")
    top = met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= need)  # Spark applies the limit before the shuffle too
    return top.groupBy(*keys, "_x", "_y").agg(F.array_sort(F.collect_list(F.struct("_d2", "_rep"))).alias("_near"))


def _nearest_of_block(queries: DataFrame, places: DataFrame, reps: DataFrame, keys: list[str], need: int, salts: int, tasks: int = 8) -> DataFrame:
    """The `need` nearest representatives for every query place that its block holds, with the block's guarantee.

    The nearest of each cell are found where the cell lies; only they travel to meet those of the other cells of the block.
    """
    def cell(c: str, lo: str):
        return F.floor((F.col(c) - F.col(lo)) / F.col("_w")).cast("long")

    around = F.explode(F.expr("flatten(transform(array(-1, 0, 1), a -> transform(array(-1, 0, 1), b -> named_struct('a', a, 'b', b))))"))
    q = queries.select(*keys, "_x", "_y", "_w", "_covers", cell("_x", "_x0").alias("_cx"), cell("_y", "_y0").alias("_cy"))
    q = q.select("*", around.alias("_d")).select(
        *keys, "_x", "_y", "_w", "_covers", (F.col("_cx") + F.col("_d.a")).alias("_cx"), (F.col("_cy") + F.col("_d.b")).alias("_cy")
    )
    cand = places.join(reps.hint("merge"), [*keys, "_x", "_y"]).select(
        *keys, F.col("_x").alias("_nx"), F.col("_y").alias("_ny"), "_rep", cell("_x", "_x0").alias("_cx"), cell("_y", "_y0").alias("_cy")
    )
    on = [*keys, "_cx", "_cy"]
    if salts > 1:
        cand = cand.withColumn("_salt", F.pmod(F.xxhash64("_nx", "_ny"), F.lit(salts)).cast("int"))
        q, on = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"]
    d2 = (F.col("_x") - F.col("_nx")) * (F.col("_x") - F.col("_nx")) + (F.col("_y") - F.col("_ny")) * (F.col("_y") - F.col("_ny"))
    met = q.repartition(tasks, *on).join(cand.repartition(tasks, *on).hint("merge"), on).select(*on, "_x", "_y", "_w", "_covers", "_rep", d2.alias("_d2"))
    first = lambda d, *by: d.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_x", "_y").orderBy("_d2", "_rep"))).filter(F.col("_r") <= need)
    held = first(met, *on).select(*keys, "_x", "_y", "_w", "_covers", "_rep", "_d2")
    top = first(held.repartition(tasks, *keys, "_x", "_y"), *keys)
    packed = top.groupBy(*keys, "_x", "_y").agg(
        F.array_sort(F.collect_list(F.struct("_d2", "_rep"))).alias("_near"), F.first("_w").alias("_w"), F.first("_covers").alias("_covers")
    )
    safe = F.col("_w") * F.lit(1.0 - 1.0e-9)
    certain = (F.size("_near") >= need) & (F.element_at("_near", -1)["_d2"] <= safe * safe)
    return packed.select(*keys, "_x", "_y", "_near", (F.col("_covers") | certain).alias("_done"))


def knn(points: DataFrame, keys: list[str], k: int, point_id: str = "spot_id", small: int | None = None) -> DataFrame:
    """Edges (keys, id, neighbor_id, d2, rank): the k nearest other points of the group, fewer in smaller groups.

    Ties are broken by id. `d2` is the squared distance. Points without a finite place are left out.
    """
    near = neighbor_lists(points, keys, k, point_id, small)
    return near.select(*keys, point_id, F.posexplode("near").alias("_i", "_e")).select(
        *keys, point_id, F.col("_e._rep").alias("neighbor_id"), F.col("_e._d2").alias("d2"), (F.col("_i") + 1).alias("rank")
    )


def neighbor_lists(
    points: DataFrame, keys: list[str], k: int, point_id: str = "spot_id", small: int | None = None, carry: str | None = None, keep: tuple[str, ...] = (),
    together: bool = False,
) -> DataFrame:
    """A row per point with `near`, its neighbours in order as (_d2, _rep) and, as `_v`, their values of the column `carry`.

    The values come along where a group is gathered anyway, so no edge is shuffled to fetch them; only large groups join them.
    `keep` names columns of the point itself. `together` says that the points of a group lie in one partition already: small groups are
    then compared where they are.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    small = SMALL * (k + 1) if small is None else small
    value = [F.col(carry).alias("_v")] if carry else []
    pts = points.select(*keys, F.col(point_id).alias("_id"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), *value, *keep)
    pts = pts.filter(_finite("_x") & _finite("_y"))
    pts = with_named_stats(pts, keys, {"_n": F.count(F.lit(1))}, together)
    carried = ["_v"] if carry else []
    if together and pts.filter(F.col("_n") > small).isEmpty():
        near = _compare_all(pts, keys, k, carried, keep, together)
        return near.withColumnsRenamed({"_id": point_id, "_near": "near"})
    pts = materialise(pts)
    near = _compare_all(pts.filter(F.col("_n") <= small), keys, k, carried, keep)
    large = pts.filter(F.col("_n") > small).drop("_n")
    if not large.isEmpty():
        found = _search_grid(large.drop("_v", *keep), keys, k)
        if carry:
            there = large.select(*keys, F.col("_id").alias("_rep"), "_v")
            edges = found.select(*keys, "_id", F.explode("_near").alias("_e")).select(*keys, "_id", "_e.*").join(there.hint("merge"), [*keys, "_rep"])
            found = edges.groupBy(*keys, "_id").agg(F.array_sort(F.collect_list(F.struct("_d2", "_rep", "_v"))).alias("_near"))
        if keep:
            found = found.join(large.select(*keys, "_id", *keep).hint("merge"), [*keys, "_id"])
        near = near.unionByName(found)
    return near.withColumnsRenamed({"_id": point_id, "_near": "near"})


def _compare_all(pts: DataFrame, keys: list[str], k: int, carried: list[str] = [], keep: tuple[str, ...] = (), together: bool = False) -> DataFrame:  # noqa: B006
    """For groups of at most a fixed number of points: gather the group and sort its distances, point by point.

    The rows are few bytes but much work, so the number of partitions is the configured one, not what their size suggests.
    """
    whole = F.collect_list(F.struct("_x", "_y", "_id", *carried))
    if together:
        met = pts.withColumn("_all", whole.over(W.partitionBy(*keys)))
    else:
        pts = pts.repartition(int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        met = pts.join(pts.groupBy(*keys).agg(whole.alias("_all")).hint("merge"), keys)
    others = F.filter("_all", lambda s: s["_id"] != F.col("_id"))

    def apart(s):
        dx, dy = F.col("_x") - s["_x"], F.col("_y") - s["_y"]
        return F.struct((dx * dx + dy * dy).alias("_d2"), s["_id"].alias("_rep"), *[s[c].alias(c) for c in carried])

    return met.select(*keys, "_id", F.slice(F.array_sort(F.transform(others, apart)), 1, k).alias("_near"), *keep)


def _search_grid(pts: DataFrame, keys: list[str], k: int) -> DataFrame:
    need = k + 1
    # Spark applies the rank limit before the shuffle as well, so a pile of points is cut down where it lies.
    at_place = W.partitionBy(*keys, "_x", "_y").orderBy("_id")
    reps = pts.withColumn("_r", F.row_number().over(at_place)).filter(F.col("_r") <= need)
    reps = materialise(reps.select(*keys, "_x", "_y", F.col("_id").alias("_rep")))
    places = reps.select(*keys, "_x", "_y").distinct()
    span = F.greatest(F.col("_sx"), F.col("_sy"))
    box = places.groupBy(*keys).agg(
        F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), (F.max("_x") - F.min("_x")).alias("_sx"), (F.max("_y") - F.min("_y")).alias("_sy"),
    ).select(*keys, "_x0", "_y0", F.when(span > 0, span).otherwise(F.lit(1.0)).alias("_span"))
    boxed = places.join(box.hint("merge"), keys)
    tasks = max(int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-reps.count() // PLACES_PER_TASK))
    steps = boxed.repartition(tasks, *keys, "_x", "_y").select("*", F.explode(F.sequence(F.lit(0), F.lit(LADDER - 1))).alias("_j"))
    cells = [F.floor((F.col(c) - F.col(lo)) / (F.col("_span") / F.pow(F.lit(4.0), F.col("_j")))).alias(n) for c, lo, n in (("_x", "_x0", "_cx"), ("_y", "_y0", "_cy"))]
    held = steps.groupBy(*keys, "_j", *cells).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    felt = held.groupBy(*keys, "_j").agg((F.sum(F.col("_c") * F.col("_c")) / F.sum("_c")).alias("_felt"))
    first = felt.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_felt") <= 2 * need, F.col("_j"))), F.lit(LADDER - 1)).alias("_j"))
    places = materialise(boxed.join(first.hint("merge"), keys).withColumn("_w0", F.col("_span") / F.pow(F.lit(4.0), F.col("_j"))).drop("_j"))
    found, pending = None, places
    for r, grown in enumerate(GROWTH):
        w = F.col("_w0") * F.lit(float(grown))
        grid = places.withColumn("_w", w)
        queries = pending.withColumn("_w", w).withColumn("_covers", F.col("_w") >= F.col("_span"))
        near = materialise(_nearest_of_block(queries, grid, reps, keys, need, 1 if r < 2 else SALTS, tasks))
        done = near.filter("_done").drop("_done")
        found = done if found is None else found.unionByName(done)
        left = near.filter("NOT _done").select(*keys, "_x", "_y")
        waiting = left.count()
        if waiting == 0:
            break
        if waiting <= FEW:
            found = found.unionByName(_nearest_of_all(left, reps, keys, need))
            break
        pending = places.join(left.hint("merge"), [*keys, "_x", "_y"], "left_semi")
    else:
        raise InputError(f"{waiting} points without their neighbours")  # the last width covers every group
    others = F.filter("_near", lambda s: s["_rep"] != F.col("_id"))
    return pts.join(found.hint("merge"), [*keys, "_x", "_y"]).select(*keys, "_id", F.slice(others, 1, k).alias("_near"))
