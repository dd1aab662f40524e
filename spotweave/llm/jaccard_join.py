"""Operator 9: n-gram Jaccard join by filtering under several global token orders.

A document is its set of distinct word n-grams (tokens). Two sets of n tokens with Jaccard similarity >= t share at least one token
among the first n - ceil(t n) + 1 tokens of any one global order. So a candidate pair must share such a prefix token under every one
of several orders: rare tokens first, and hash orders. In all of them tokens of a single document come first: they cannot be shared, so
a document with more of them than its prefix is long has no partner at all and leaves the join at once.

1. One scan turns texts into tokens. Tokens travel as packed blocks per shard (six bytes a token and a reference to the document), and
   identical sets inside a batch once. A shard counts documents per token and gives out the tokens of two or more documents.
2. Identical sets are one class. A class keeps its shared tokens, in which every overlap can be counted.
3. Classes meet in the buckets of their prefix tokens of the first order. In rounds, one member of every component in a bucket meets a
   few members, drawn anew each round, of the largest component; links merge components, so large groups of near copies cost a few
   comparisons each and not all pairs. When links have become rare, the pairs of a bucket that still lie in different components are
   compared, all of them. Every pair first passes the size filter, then the prefix filters of the other orders, which are intersected
   before the sets themselves are read, then the exact count.
4. Components are found by shrinking the graph of links, label by label.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, functions as F

from spotweave.llm.common import bounded_batches, give_back, text_of
from spotweave.session import materialise

WORDS = 5
PERCENT = 75
SHARD_BYTES = 8 << 20  # text bytes that fill one shard, about a million tokens
BLOCK_TOKENS = 500_000  # tokens that a scan task holds at a time
ORDERS = (17, 91)  # seeds of the hash orders
HUBS = 8  # members of the largest component of a bucket that the other components meet in a round
BROADCAST_PAIRS = 200_000  # pairs whose ends (two longs each) are broadcast to pick their sets; more are shuffled, with the same rows
RARE = 20  # rounds end when, twice in a row, less than one comparison in so many is a link
_SCHEMA = "shard int, pack int, docs binary, tokens binary, refs binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 100_000:
            self.clear()
        self[word] = h
        return h


def shingles(text: str, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit tokens. With fewer words than a shingle, the whole sequence is one; without words there is none."""
    w = text.encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at U+0020 and U+0009-U+000D
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], dtype=np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w))
    n = len(w) - words + 1
    h = ids[:n].copy()
    for k in range(1, words):
        h = _mix(h + np.uint64(k)) ^ ids[k : n + k]
    return np.unique(_mix(h))


_ROW = [("id", "<i8"), ("ok", "?"), ("d1", "<i8"), ("d2", "<i8"), ("n", "<i8")]


def _blocks(sets: list, shards: int) -> list[tuple]:
    """Tokens of some sets (handle, tokens), cut by shard: (shard, pack, handles, tokens, references to the handles)."""
    tokens = np.concatenate([h for _, h in sets])
    refs = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(h) for _, h in sets])
    order = np.argsort(tokens)
    tokens, refs = tokens[order], refs[order]
    del order
    shard = ((tokens >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # rises with the tokens
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    handles = np.array([a for a, _ in sets], dtype=np.int64)
    low = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    out = []
    for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
        a, b = cuts[s], cuts[s + 1]
        used, local = np.unique(refs[a:b], return_inverse=True)
        out.append((int(s), 1, handles[used].tobytes(), low[a:b].tobytes(), local.astype(np.uint16).tobytes()))
    return out


def _pack(shards: int, words: int):
    """Batches of (doc_id, text) to blocks of tokens per shard, and blocks of document rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        rows: list[tuple] = []
        sets: list[tuple] = []
        seen: set = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = np.array(rows, dtype=_ROW)
            out = [(-1 - int(abs(int(table["d1"][0])) % shards), 0, table.tobytes(), b"", b"")] + (_blocks(sets, shards) if sets else [])
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                names=["shard", "pack", "docs", "tokens", "refs"],
            )

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                h = shingles(t.as_py(), hashes, words)
                d = xxhash.xxh3_128_digest(h.tobytes())
                a, b = np.frombuffer(d, dtype=np.int64)
                rows.append((i.as_py() if i.is_valid else 0, i.is_valid, a, b, len(h)))
                if len(h) and d not in seen:
                    seen.add(d)
                    sets.append((a, h))
                    size += len(h)
                if size >= BLOCK_TOKENS or len(sets) >= 65_000 or len(rows) >= 200_000:
                    yield from flush()
                    rows, sets, seen, size = [], [], set(), 0
        if rows:
            yield from flush()
        del rows, sets, seen
        hashes.clear()
        give_back()

    return run


_FOUND = "kind int, doc_id long, d1 long, d2 long, n long, token long, df int"


def _count(key: tuple, blocks: pa.Table) -> pa.Table:
    """As `_counted`; the arrays of a shard, many times its rows, are given back before the next one comes."""
    try:
        return _counted(key, blocks)
    finally:
        give_back()


def _counted(key: tuple, blocks: pa.Table) -> pa.Table:
    """A shard: the tokens of two or more documents with their document counts. Blocks of document rows are unpacked."""
    shard = key[0].as_py()
    if shard < 0:
        t = np.concatenate([np.frombuffer(x.as_buffer(), dtype=_ROW) for x in blocks["docs"]])
        return _found(0, pa.array(t["id"], mask=~t["ok"]), t["d1"], t["d2"], t["n"], np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int32))
    ends = np.cumsum([len(x.as_buffer()) // 6 for x in blocks["tokens"]])
    tok, doc = np.zeros(ends[-1], dtype="<u8"), np.empty(ends[-1], dtype=np.int64)
    low, start = tok.view(np.uint8).reshape(-1, 8), 0
    for end, tokens, docs, refs in zip(ends, blocks["tokens"], blocks["docs"], blocks["refs"]):
        low[start:end, :6] = np.frombuffer(tokens.as_buffer(), dtype=np.uint8).reshape(-1, 6)
        doc[start:end] = np.frombuffer(docs.as_buffer(), dtype=np.int64)[np.frombuffer(refs.as_buffer(), dtype=np.uint16)]
        start = end
    order = np.argsort(tok, kind="stable")
    tok = tok[order]
    same = tok[1:] == tok[:-1]
    twice = np.zeros(len(tok), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    tok, doc = tok[twice], doc[order[twice]]
    del order, low, same, twice
    order = np.lexsort((doc, tok))
    tok, doc = tok[order], doc[order]
    df = np.empty(0, dtype=np.int64)
    if len(tok):
        new = np.ones(len(tok), dtype=bool)
        new[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])
        tok, doc = tok[new], doc[new]
        _, at, df = np.unique(tok, return_inverse=True, return_counts=True)
        df = df[at]
        tok, doc, df = tok[df > 1], doc[df > 1], df[df > 1]
    base = np.uint64((shard * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) if shard >> 16 else np.uint64(shard << 48)
    zero = np.zeros(len(tok), dtype=np.int64)
    return _found(1, pa.nulls(len(tok), pa.int64()), doc, zero, zero, (tok + base).view(np.int64), df.astype(np.int32))


def _found(kind: int, ids: pa.Array, *columns: np.ndarray) -> pa.Table:
    kinds = pa.array(np.full(len(ids), kind, dtype=np.int32))
    return pa.table([kinds, ids, *map(pa.array, columns)], names=["kind", "doc_id", "d1", "d2", "n", "token", "df"])


def need(n_small: Column, n_large: Column, percent: int) -> Column:
    """Least overlap of two sets with 100 * overlap >= percent * union."""
    return F.ceil((n_small + n_large) * percent / (100 + percent))


def prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100) + 1


def _other_orders(sets: DataFrame, percent: int) -> DataFrame:
    """`sets` (node, n, tokens) with o0, o1, ...: the prefix under each hash order. Tokens of one document come first in every order."""
    long_ = (prefix_length(F.col("n"), percent) - (F.col("n") - F.size("tokens"))).cast("int")
    hashed = lambda seed: F.sort_array(F.transform("tokens", lambda t: F.xxhash64(F.lit(seed), t)))
    return sets.select("*", *[F.slice(hashed(seed), F.lit(1), long_).alias(f"o{k}") for k, seed in enumerate(ORDERS)])


def _overlap(percent: int):
    """Rows (a, na, ta, b, nb, tb) to links (a, b), by the exact count of shared tokens."""

    def similar(na: int, ta: np.ndarray, nb: int, tb: np.ndarray) -> bool:
        least = -(-(na + nb) * percent // (100 + percent))
        return min(len(ta), len(tb)) >= least and len(np.intersect1d(ta, tb, assume_unique=True)) >= least

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ok = [similar(r.na, np.asarray(r.ta, dtype=np.int64), r.nb, np.asarray(r.tb, dtype=np.int64)) for r in df.itertuples(index=False)]
            yield df.loc[ok, ["a", "b"]]
        give_back()

    return run


def _links(pairs: DataFrame, tried: int, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold, of `tried` ones. The prefixes of the other orders are intersected first; whole sets are joined to
    what is left. Only the sets of a pair are shuffled: late rounds have few pairs, and the optimizer takes their joins for large.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = sets.join(F.broadcast(ends) if tried <= BROADCAST_PAIRS else ends, "node", "left_semi")
    orders = [f"o{k}" for k in range(len(ORDERS))]
    side = lambda c, cols: sets.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in cols])
    left = pairs.join(side("a", orders), "a").join(side("b", orders), "b")
    for o in orders:
        left = left.filter(F.arrays_overlap(f"{o}_a", f"{o}_b"))
    whole = left.select("a", "b").join(side("a", ["n", "tokens"]), "a").join(side("b", ["n", "tokens"]), "b")
    return whole.select("a", F.col("n_a").alias("na"), F.col("tokens_a").alias("ta"), "b", F.col("n_b").alias("nb"), F.col("tokens_b").alias("tb")).mapInPandas(
        _overlap(percent), "a long, b long"
    )


def _stored(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """The stored table and how many rows it has (or `what` added up), counted while it is written."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    counted = F.count(F.lit(1)) if what is None else F.sum(what)
    out = materialise(df.observe(seen, F.coalesce(counted, F.lit(0)).alias("n")))
    return out, int(seen.get["n"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable; `links` has a and b.

    In each step every node takes the smallest node next to it as its label, and the graph shrinks to the links between labels. The
    smallest node of a component never changes its label, so it is the last one left.
    """
    edges = materialise(links.select(*_ordered(F.col("a"), F.col("b"))).filter("a < b").distinct())
    labels: DataFrame | None = None
    while True:
        both = edges.union(edges.select("b", "a"))
        step = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")))
        if labels is None:
            labels = step
        else:
            further = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            labels = materialise(labels.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        x, y = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        shrunk = edges.join(x, "a").join(y, "b").select(*_ordered(F.col("a_to"), F.col("b_to"))).filter("a < b").distinct()
        edges, left = _stored(shrunk)
        if not left:
            break
    return nodes.join(labels, "node", "left").select("node", F.coalesce("to", "node").alias("comp"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _round(placed: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b): what the components of each bucket compare in round `k`.

    A bucket is dealt by size, so that all sizes in a class may be linked; the borders of the classes shift every other round. One
    member of each component meets up to `HUBS` members of the largest one. Members are drawn by a hash that changes by round.
    """
    group = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + F.lit(k % 2 / 2)) if percent < 100 else F.col("n")
    drawn = placed.select("token", group.alias("size"), "comp", F.struct(F.xxhash64(F.lit(k), "node").alias("at"), "node", "n", "rest").alias("m"))
    keys = ["token", "size"]
    some = drawn.groupBy(*keys, "comp", F.pmod("m.at", F.lit(HUBS)).alias("slot")).agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("members"))
    one = some.groupBy(*keys, "comp").agg(F.min("m").alias("m"), F.sum("members").alias("members"))
    largest = one.groupBy(*keys).agg(F.max(F.struct("members", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    largest = largest.select(*keys, F.col("top.comp").alias("hub"))
    hubs = some.join(largest, keys).filter("comp = hub").select(*keys, "hub", F.col("m").alias("y"))
    met = one.select(*keys, "comp", F.col("m").alias("x")).join(hubs, keys).filter("comp <> hub")
    return met.filter(_fits("x", "y", percent)).select(*_ordered(F.col("x.node"), F.col("y.node"))).distinct()


def _fits(x: str, y: str, percent: int) -> Column:
    """Neither the sizes nor what is left of the sets from this token on rule a link out."""
    n = [F.col(f"{x}.n"), F.col(f"{y}.n")]
    rest = F.least(F.col(f"{x}.rest"), F.col(f"{y}.rest"))
    return (100 * F.least(*n) >= percent * F.greatest(*n)) & (rest * (100 + percent) >= percent * (n[0] + n[1]))


def _open_rows(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of buckets with members of different components, with comp. A bucket that is closed never opens again."""
    placed = buckets.join(comp, "node")
    open_ = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return materialise(placed.join(open_, "token", "left_semi"))


def _open_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of a bucket that lie in different components."""
    x, y = placed.alias("x"), placed.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp")) & _fits("x", "y", percent)
    return x.join(y, on).select(*_ordered(F.col("x.node"), F.col("y.node"))).distinct()


def similar_sets(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) for the nodes of `sets` (node, n, tokens). `buckets` has token, node, n, rest: rows per prefix token.

    `rest` is how many tokens of the node come from this one on: no pair can have more in common if this is the first it shares.
    Every pair of a bucket ends in one component or has been compared.
    """
    nodes = materialise(sets.select("node").distinct())
    sets = materialise(_other_orders(sets.join(buckets.select("node").distinct(), "node", "left_semi"), percent))
    compared: DataFrame | None = None
    comp = nodes.withColumn("comp", F.col("node"))
    placed = buckets.withColumn("comp", F.col("node"))
    k = quiet = 0
    while True:
        exhaustive = quiet > 1
        pairs, tried = _stored(_open_pairs(placed, percent) if exhaustive else _round(placed, percent, k))  # distinct first: a pair meets in many tokens
        if compared is not None and tried:
            pairs, tried = _stored(pairs.join(compared, ["a", "b"], "left_anti"))
        compared = pairs if compared is None else compared.union(pairs)
        found, held = _stored(_links(pairs, tried, sets, percent)) if tried else (None, 0)
        if held:
            ca, cb = (comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
            joined = components(comp.select(F.col("comp").alias("node")).distinct(), found.join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            comp = materialise(comp.withColumnRenamed("comp", "old").join(joined.select(F.col("node").alias("old"), "comp"), "old").select("node", "comp"))
        if exhaustive:
            return comp
        if held:
            placed = _open_rows(placed.drop("comp"), comp)
        k, quiet = k + 1, quiet + 1 if held * RARE <= tried else 0


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Sets are linked when 100 * intersection >= percent * union; identical sets always. A null text, or one without words, has an empty
    set and no links. Rows with one id are one document (their sets share its component); rows with a null id form a document per set
    that links with nothing else, with a null component. Other columns do not take part; empty tables give empty results.
    """
    d = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_t"))
    total = d.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
    shards = max(64, -(-total // SHARD_BYTES))
    packed = d.mapInArrow(_pack(int(shards), words), _SCHEMA)
    found = materialise(packed.groupBy("shard").applyInArrow(_count, _FOUND))
    rows = found.filter("kind = 0").select("doc_id", "d1", "d2", "n")
    classes = materialise(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node")))
    shared = found.filter("kind = 1").groupBy("d1").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    full = classes.join(shared, "d1").select("node", "n", F.expr("transform(t, x -> x.token)").alias("tokens"))
    long_ = (prefix_length(F.col("n"), percent) - (F.col("n") - F.size("tokens"))).cast("int")
    sets = materialise(full.withColumn("p", long_).filter("p > 0"))
    size = F.size("tokens")
    buckets = sets.select(F.posexplode(F.expr("slice(tokens, 1, p)")).alias("at", "token"), "node", "n", size.alias("size"))
    buckets = buckets.select("token", "node", "n", (F.col("size") - F.col("at")).cast("long").alias("rest"))
    met = buckets.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token")
    buckets = materialise(buckets.join(met, "token", "left_semi"))
    comp = similar_sets(buckets, sets.select("node", "n", "tokens"), percent)
    # an id may stand for several sets; they are one document then
    key = F.struct("d1", "d2", "n")
    several = rows.filter("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo <> hi")
    several, ids = _stored(several.select("doc_id"))
    if ids:
        named = classes.join(rows.filter("doc_id IS NOT NULL").select("doc_id", "d1", "d2", "n").distinct(), ["d1", "d2", "n"]).select("doc_id", "node")
        extra = named.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        more = comp.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
        everyone = named.select(F.col("doc_id").alias("node")).union(named.select("node")).distinct()
        comp = materialise(components(everyone, extra.union(more)))
    label = classes.join(comp, "node", "left").select("d1", "d2", "n", F.coalesce("comp", "node").alias("comp"))
    out = rows.join(label, ["d1", "d2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
