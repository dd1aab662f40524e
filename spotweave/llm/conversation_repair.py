"""Operator 12: repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A repaired conversation has roles whose initials follow `(s?(ua)+)?`. Nodes of the lattice are (rows consumed, state of that pattern);
edges keep, rerole or delete the next row or insert an empty one. A forward and a reverse heap grow towards each other, the cheaper one
first. They go on until no path as cheap as the best can cross any more, so all crossings of equal cost are known, and the
least audit (the edits' initials) over them is taken.

Spark orders the rows, finds their faults and packs a conversation into segments of bounded length, one letter a row; only these letters
reach Python. A segment is solved between all states it may be entered and left in, segments are folded along the conversation, so
a conversation of any length is solved in pieces. Equal letter sequences are solved once per worker.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from spotweave.llm.common import SPACES
from spotweave.operators.ordering import row_number
from spotweave.session import materialise

START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after s, after u, after a
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTED = frozenset([START, ASSISTANT])
ROLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT = 2048  # rows

#: Letters of a row: its role initial (o: another one), in upper case if truncated; x: blank or duplicate, which has to go.
GONE = "x"


def _row_edges(letter: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) of consuming a row."""
    out = [(DELETE, "D", state)]
    if letter != GONE:
        extra = TRUNCATED if letter.isupper() else 0
        if (state, letter.lower()) in NEXT:
            out.append((extra, "K", NEXT[state, letter.lower()]))
        out += [(REROLE + extra, "R", NEXT[state, r]) for r in ROLE if (state, r) in NEXT]
    return out


def _edges(letters: str, node: tuple[int, int]) -> list[tuple[int, str, tuple[int, int]]]:
    i, state = node
    out = [(INSERT, "I", (i, NEXT[state, r])) for r in ROLE if (state, r) in NEXT]
    if i < len(letters):
        out += [(c, e, (i + 1, q)) for c, e, q in _row_edges(letters[i], state)]
    return out


def _reverse_edges(letters: str, node: tuple[int, int]) -> list[tuple[int, str, tuple[int, int]]]:
    i, state = node
    out = [(INSERT, "I", (i, q)) for q in range(4) for r in ROLE if NEXT.get((q, r)) == state]
    if i:
        out += [(c, e, (i - 1, q)) for q in range(4) for c, e, q2 in _row_edges(letters[i - 1], q) if q2 == state]
    return out


@lru_cache(maxsize=200_000)
def cheapest(letters: str, start: int, ends: frozenset[int]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state `start` to one of `ends`, the least audit among equals; None if there are none.

    Equally cheap paths to a node never are a prefix of each other (only inserts consume no row, and they cost), so the least audit of a
    whole path has the least audit on both sides of every crossing. Zero-cost edges consume a row: within a cost, nodes are settled in the
    order of rows, forward from the first and in reverse from the last.
    """
    n = len(letters)
    best: tuple[int, str] | None = (0, "") if n == 0 and start in ends else None
    heaps = ([(0, 0, "", (0, start))], [(0, -n, "", (n, q)) for q in sorted(ends)])
    heapq.heapify(heaps[1])
    done: tuple[dict, dict] = ({}, {})
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, audit, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side][node] = (cost, audit)
        other = done[1 - side]
        for c, edit, near in (_reverse_edges if side else _edges)(letters, node):
            grown = edit + audit if side else audit + edit
            if near in other:
                c2, audit2 = other[near]
                crossing = (cost + c + c2, grown + audit2 if side == 0 else audit2 + grown)
                best = crossing if best is None else min(best, crossing)
            if near not in done[side]:
                heapq.heappush(heaps[side], (cost + c, -near[0] if side else near[0], grown, near))
    return best


def output_rows(letters: str, start: int, audit: str) -> list[tuple[int | None, str | None, str]]:
    """(row number or None for an insert, new role or None for the row's own, edit) of the rows that stay."""
    out, i, state = [], 0, start
    for edit in audit:
        own = letters[i].lower() if edit == "K" else None
        if edit in "RI":
            own = "a" if state == USER else "u"
        if edit != "D":
            out.append((None if edit == "I" else i, None if edit == "K" else ROLE[own], edit))
            state = NEXT[state, own]
        i += edit != "I"
    return out


def _list_of(**fields: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(name, kind) for name, kind in fields.items()]))


@F.pandas_udf(_list_of(start=IntegerType(), end=IntegerType(), cost=LongType(), audit=StringType()))
def _solve(letters: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """The cheapest way between every two states; a first segment starts at the start, a last one ends in an accepted state."""
    out = []
    for text, f, z in zip(letters, first, last):
        paths = []
        for start in [START] if f else range(4):
            if f and z:
                cost, audit = cheapest(text, START, ACCEPTED)
                paths.append({"start": START, "end": -1, "cost": cost, "audit": audit})
                continue
            for end in sorted(ACCEPTED) if z else range(4):
                found = cheapest(text, start, frozenset([end]))
                if found is not None:
                    paths.append({"start": start, "end": end, "cost": found[0], "audit": found[1]})
        out.append(paths)
    return pd.Series(out)


def _fold(segments: list[list[dict]]) -> list[dict]:
    """One path per segment: together the cheapest from start to an accepted state, the least audit among equals."""
    best: dict[int, tuple[int, str, list]] = {START: (0, "", [])}
    for paths in segments:
        ahead: dict[int, tuple[int, str, list]] = {}
        for p in paths:
            if p["start"] in best:
                cost, audit, taken = best[p["start"]]
                found = (cost + p["cost"], audit + p["audit"], [*taken, p])
                if p["end"] not in ahead or found[:2] < ahead[p["end"]][:2]:
                    ahead[p["end"]] = found
        best = ahead
    return min(best.values(), key=lambda b: b[:2])[2]


@F.pandas_udf(_list_of(start=IntegerType(), cost=LongType(), audit=StringType()))
def _folded(segments: pd.Series) -> pd.Series:
    return pd.Series([[{k: p[k] for k in ("start", "cost", "audit")} for p in _fold([s["paths"] for s in row])] for row in segments])


@F.pandas_udf(_list_of(at=IntegerType(), role=StringType(), edit=StringType()))
def _plan(letters: pd.Series, start: pd.Series, audit: pd.Series) -> pd.Series:
    return pd.Series([[{"at": i, "role": r, "edit": e} for i, r, e in output_rows(*row)] for row in zip(letters, start, audit)])


def faults(rows: DataFrame, key: str) -> DataFrame:
    """`rows` (key, turn, role, text, none of the last two null) with `pos`, from 1 by turn (nulls first), role and text, and the first
    `fault` of the row: blank, duplicate or truncated, null if sound."""
    d = materialise(row_number(rows, [key], [F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("text")], "pos"))
    first = d.groupBy(key, "role", "text").agg(F.min("pos").alias("first_pos"))  # folded per task before it is dealt
    bare = F.btrim("text", F.lit(SPACES))
    ended = F.substring(bare, -1, 1).isin(".", "!", "?")
    fault = F.when(bare == "", "blank").when(F.col("pos") > F.col("first_pos"), "duplicate").when(~ended, "truncated")
    return d.join(first, [key, "role", "text"]).select(*rows.columns, "pos", fault.alias("fault"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The report, a row per conversation: conv_id, the longs of COUNTS, audit; and the repaired rows: conv_id, segment, place, turn, role,
    text, edit (K, R or I), in the order of (segment, place).

    `conversations` has conv_id, turn, role and text; other columns, whatever their names, do not take part. Null roles and texts are
    one space; rows without a conv_id are one conversation; rows of equal turn, and of no turn, follow role and text. Repeated rows
    are duplicates of the first. An empty table gives empty tables. Reports of conversations of any length are folded from segments; the
    audit itself is one string.
    """
    blank_to = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = conversations.select(key.alias("key"), "conv_id", "turn", blank_to("role"), blank_to("text"))
    found = faults(rows, "key")
    head = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE)).when(F.col("fault") == "truncated", F.upper(head)).otherwise(head)
    marked = found.withColumn("segment", F.floor((F.col("pos") - 1) / segment).cast("int")).withColumn("letter", letter).withColumn("head", head)
    is_ = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    packed = marked.groupBy("key", "segment").agg(
        F.any_value("conv_id").alias("conv_id"), is_("blank"), is_("duplicate"), is_("truncated"),
        F.array_sort(F.collect_list(F.struct("pos", "letter", "head", "turn", "role", "text"))).alias("rows"),  # at most `segment` rows
    )
    packed = materialise(packed.withColumn("letters", F.array_join("rows.letter", "")).withColumn("heads", F.array_join("rows.head", "")))

    along = Window.partitionBy("key").orderBy("segment")
    legal = F.lit("(?=su|ua|au)")
    small = packed.select("key", "conv_id", "segment", "letters", "blank", "duplicate", "truncated", "heads").withColumns({
        "first": F.col("segment") == 0, "last": F.lead("segment").over(along).isNull(),
        "joint": F.concat(F.coalesce(F.substring(F.lag("heads").over(along), -1, 1), F.lit("")), F.col("heads")),
    })
    small = small.withColumn("illegal", F.greatest(F.length("joint") - 1, F.lit(0)) - F.regexp_count("joint", legal))
    small = small.withColumn("paths", _solve("letters", "first", "last"))
    whole = small.groupBy("key").agg(
        F.any_value("conv_id").alias("conv_id"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.array_sort(F.collect_list(F.struct("segment", "paths"))).alias("segments"),
    )
    whole = materialise(whole.withColumn("chosen", _folded("segments")).drop("segments"))
    turns = marked.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    cost = F.aggregate("chosen.cost", F.lit(0).cast("long"), lambda a, b: a + b)
    report = whole.join(turns, "key").select(
        "conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", cost.alias("cost"),
        F.array_join("chosen.audit", "").alias("audit"),
    )

    paths = whole.select("key", F.posexplode("chosen").alias("segment", "path")).select("key", "segment", "path.start", "path.audit")
    planned = packed.join(paths, ["key", "segment"]).withColumn("plan", _plan("letters", "start", "audit"))
    source = lambda p, c: F.get(F.col("rows")[c], p["at"])
    kept = F.transform("plan", lambda p: F.struct(
        source(p, "turn").alias("turn"), F.coalesce(p["role"], source(p, "role")).alias("role"),
        F.coalesce(source(p, "text"), F.lit("")).alias("text"), p["edit"].alias("edit"),
    ))
    repaired = planned.select("conv_id", "segment", F.posexplode(kept).alias("place", "r")).select("conv_id", "segment", "place", "r.*")
    return report, repaired


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by crc32 of `conv_id:turn` modulo 20; nulls are one space."""
    text_or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", text_or_space("role").alias("role"), text_or_space("text").alias("text"))
    d = d.withColumn("hit", F.crc32(F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn")).cast("binary")) % 20).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_")).drop("_")


def digest(conversations: DataFrame, report: DataFrame, repaired: DataFrame) -> DataFrame:
    """A row per conversation of the original table, with the hash of its repaired rows as text. The hash needs a conversation in one piece."""
    line = F.concat("role", F.lit(":"), "text")
    texts = repaired.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "place", line.alias("line")))).alias("lines"))
    texts = texts.select(F.col("conv_id").alias("_t"), F.sha2(F.array_join("lines.line", "\n"), 256).alias("hash"))
    known = report.withColumnRenamed("conv_id", "_r")
    d = conversations.select("conv_id").distinct()
    d = d.join(known, F.col("conv_id").eqNullSafe(F.col("_r")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("_t")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return d.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
