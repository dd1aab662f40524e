"""Operator 10: mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of rows. A fluid mixer would deliver all sources at once at their weights; when a source runs out, the
others share its part in proportion. Block j of a source may be released once the fluid mixer begins with it and is due when the fluid
mixer ends it, both in whole slots. Earliest-deadline-first over the released blocks then meets all deadlines, so in every prefix of
the mix a source is less than one block away from its fluid share.

The schedule needs the size of each source only and has at most `most_blocks` blocks plus one per source: the block size grows with
the data. Rows find their block by rank in a hash order of their source, which is summed up over hash buckets, not sorted as a whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.llm.common import packed, two_hashes, unpacked
from spotweave.session import materialise

MOST_BLOCKS = 1_000_000
BUCKETS = 4096
WEIGHT_UNIT = 1_000_000  # weights are whole multiples of one part in a million


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, slot, release, deadline), blocks from 0. `blocks` and `weights` are whole numbers per source.

    Windows are exact: with virtual time v, the fluid mixer has delivered T(v) = sum of min(blocks, weight * v).
    """
    live = sorted((s for s in blocks if blocks[s] > 0), key=lambda s: (blocks[s] / weights[s], str(s)))
    events: list = []
    done, rate = 0, sum(weights[s] for s in live)
    phases = []  # (end of the phase as blocks / weight, blocks of sources that ended before, weight of the others)
    for s in live:
        phases.append((blocks[s], weights[s], done, rate))
        done, rate = done + blocks[s], rate - weights[s]
    for s in live:
        w, at = weights[s], 0
        release = 0
        for j in range(1, blocks[s] + 1):
            while j * phases[at][1] > phases[at][0] * w:  # j / w lies beyond the end of the phase
                at += 1
            _, _, base, others = phases[at]
            whole, rest = divmod(base * w + j * others, w)
            events.append((release, whole + (rest > 0), str(s), j - 1, s))
            release = whole
    events.sort()
    ready: list = []
    i, slot = 0, 0
    while i < len(events) or ready:
        while i < len(events) and events[i][0] <= slot:
            release, due, name, j, s = events[i]
            heapq.heappush(ready, (due, name, j, release, s))
            i += 1
        due, _, j, release, s = heapq.heappop(ready)
        yield s, j, slot, release, due
        slot += 1


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, default_weight: float = 1.0, most_blocks: int = MOST_BLOCKS,
    least_rows: int = 64, source_col: str = "source", id_col: str = "doc_id", seed_cols: list[str] | None = None,
) -> DataFrame:
    """`docs` with mix_block, mix_slot and mix_position (from 0, dense and unique): the place of each row in the mix.

    Weights are given per source (`default_weight` for others); without any, they follow size ** `alpha`. All rows are placed, none is
    dropped or repeated. Null sources are one source; repeated rows and rows with equal ids get places of their own; input columns of
    the three names are replaced. An empty table gives an empty result.
    """
    d = mix_rows(docs, weights, alpha, default_weight, most_blocks, least_rows, source_col, id_col, seed_cols)
    return unpacked(d, docs.columns, ["mix_block", "mix_slot", "mix_position"])


def mix_rows(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, default_weight: float = 1.0, most_blocks: int = MOST_BLOCKS,
    least_rows: int = 64, source_col: str = "source", id_col: str = "doc_id", seed_cols: list[str] | None = None, tie_cols: tuple[str, ...] = (),
) -> DataFrame:
    """As `mix`, with the input row as a struct `_row`.

    Rows with equal seeds follow a hash of `tie_cols`; with these two calls over the same rows differ at most in rows alike in all of them.
    """
    seeds = seed_cols or [id_col]
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))  # null differs from every name
    h = two_hashes(*[F.col(c) for c in seeds])[0]
    d = docs.select(packed(docs), source.alias("_s"), h.alias("_h"), F.pmod(h, F.lit(BUCKETS)).alias("_b"))
    sizes = d.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("n"))  # at most BUCKETS rows a source
    sizes = materialise(sizes)
    before = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_s", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_x"))
    sources = sizes.groupBy("_s").agg(F.sum("n").alias("n"))
    rows = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    block_rows = max(least_rows, -(-rows // most_blocks))
    given = {f"={k}": float(v) for k, v in (weights or {}).items()}

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One task: one row per source in, at most `most_blocks` blocks (and one more per source) out."""
        size: dict = {}
        for df in frames:
            size.update(zip(df["_s"], df["n"].astype(int)))
        if weights is None:
            w = {s: float(n) ** alpha for s, n in size.items()}
        else:
            w = {s: given.get(s, default_weight) for s in size}
        top = max(w.values(), default=1.0)
        whole = {s: max(1, round(WEIGHT_UNIT * x / top)) for s, x in w.items()}
        blocks = {s: -(-n // block_rows) for s, n in size.items()}
        out, at, chunk = [], 0, 100_000
        for s, j, slot, _, _ in schedule(blocks, whole):
            out.append((s, j, slot, at))
            at += min(block_rows, size[s] - j * block_rows)
            if len(out) == chunk:
                yield pd.DataFrame(out, columns=["_s", "mix_block", "mix_slot", "_start"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["_s", "mix_block", "mix_slot", "_start"])

    slots = materialise(sources.repartition(1).mapInPandas(plan, "_s string, mix_block long, mix_slot long, _start long"))
    inside = W.partitionBy("_s", "_b").orderBy("_h", *[F.col("_row")[c] for c in seeds], *[F.xxhash64(F.col("_row")[c]) for c in tie_cols])
    d = d.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, ["_s", "_b"])
    d = d.withColumn("_r", F.col("_r") + F.col("_x")).withColumn("mix_block", F.floor(F.col("_r") / block_rows).cast("long"))
    d = d.join(slots, ["_s", "mix_block"])
    return d.select("_row", "mix_block", "mix_slot", (F.col("_start") + F.col("_r") - F.col("mix_block") * block_rows).alias("mix_position"))
