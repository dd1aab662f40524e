"""Operator 2: quality classifier by an interpolated modified Kneser-Ney n-gram model.

A character n-gram model per language is trained on trusted texts (labelled of good quality and not toxic), all of them. Highest-order
counts are occurrences, lower orders count distinct left neighbours; each order has three discounts from its counts of counts, and
interpolates with the order below. A document's perplexity is compared with a quantile of the trusted texts of its language.

An n-gram is one long, 16 bits a character, so the context is a shift and the suffix a mask, and all counting is Spark SQL. For scoring,
documents are dealt into chunks of bounded size; a chunk asks for its distinct n-grams, the requests join the model table, sharded by
n-gram, and the answers meet the chunk again. So the model is never whole in one place, and what is moved for it follows the number of
distinct n-grams per chunk, not the number of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spotweave.llm.common import bounded_batches, text_of
from spotweave.session import materialise

ORDER = 4
BITS = 16
PIECE = 500_000  # characters handled at a time
CHUNK_BYTES = 32 << 20  # text bytes of a chunk
BROADCAST_IDS = 2_000_000  # trusted ids that may be broadcast (16 MB); beyond, the join shuffles
START = "\x01"
LEAST_DISCOUNT = 0.05  # keeps something for what was never seen


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, owner) for runs of texts: the n-gram that ends at each character and the index of its text.

    Letter case and white-space runs are levelled. Characters beyond 16 bits share the private-use range.
    """
    pad = START * (ORDER - 1)
    parts: list[str] = []
    owners: list[int] = []
    lengths: list[int] = []
    size = 0

    def done() -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        c = np.where(c > 0xFFFF, np.uint64(0xE000) + c % np.uint64(0x1900), c)
        c[c == 0] = 0xFFFD
        key = c[: len(c) - ORDER + 1].copy()
        for k in range(1, ORDER):
            key = (key << np.uint64(BITS)) | c[k : len(c) - ORDER + 1 + k]
        n = np.array(lengths)
        starts = np.concatenate([[0], np.cumsum(n + ORDER - 1)[:-1]])
        at = np.arange(n.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return key[at].view(np.int64), np.repeat(np.array(owners), n)

    for i, text in enumerate(texts):
        text = " ".join(text.lower().split())
        for a in range(0, len(text), PIECE):
            body = text[a : a + PIECE]
            parts.append((pad if a == 0 else text[a - ORDER + 1 : a]) + body)
            owners.append(i)
            lengths.append(len(body))
            size += len(body)
            if size >= PIECE:
                yield done()
                parts, owners, lengths, size = [], [], [], 0
    if parts:
        yield done()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name in sorted(set(lang)):
            total = None
            for keys, _ in pieces([t for x, t in zip(lang, text) if x == name]):
                codes, grams = pd.factorize(keys)
                one = pd.Series(np.bincount(codes), index=grams)
                total = one if total is None else total.add(one, fill_value=0)
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(total)), pa.array(total.index.to_numpy(np.int64)), pa.array(total.to_numpy(np.int64))], names=["lang", "gram", "n"]
                )


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def _context() -> Column:
    return F.shiftrightunsigned(F.col("gram"), BITS)


def train(texts: DataFrame) -> DataFrame:
    """(lang, gram, p, g): probability of every seen n-gram of orders 1 to ORDER, and what its context passes to the order below.

    Row gram = 0 of a language has the probability of an unseen character.
    """
    counts = materialise(texts.select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialise(tables[k + 1].groupBy("lang", _suffix(k + 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    below, rows = None, []
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("context", _context() if k > 1 else F.lit(0).cast("long"))
        n = [F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        # usual discounts; where a count of counts is missing, half the count
        d = [F.coalesce(F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(i)), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")))), F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)]
        off = tables[k].groupBy("lang").agg(*n).select("lang", *d)  # one row per language
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(off, "lang").withColumn("cut", cut)
        ctx = t.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"), F.count(F.lit(1)).alias("kinds"))
        ctx = ctx.select("lang", "context", "total", (F.col("cuts") / F.col("total")).alias("g"), "kinds")
        t = t.join(ctx, ["lang", "context"])
        own = F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total")
        if k == 1:
            uniform = 1.0 / (F.col("kinds") + 1)
            t = t.select("lang", "gram", (own + F.col("g") * uniform).alias("p"))
            rows.append(ctx.select("lang", F.lit(0).cast("long").alias("gram"), (F.col("g") * uniform).alias("p"), F.lit(None).cast("double").alias("g")))
        else:
            lower = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            t = t.withColumn("suffix", _suffix(k)).join(lower, ["lang", "suffix"]).select("lang", "gram", (own + F.col("g") * F.col("q")).alias("p"))
            rows.append(ctx.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "g"))
        below = materialise(t)
        rows.append(below.select("lang", "gram", "p", F.lit(None).cast("double").alias("g")))
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return materialise(both.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.max("g").alias("g")))


def _ask(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    out = []
    for name, part in df.groupby("lang", sort=True):
        found = np.empty(0, dtype=np.int64)
        for keys, _ in pieces(list(part["text"])):
            found = np.union1d(found, pd.unique(keys))
        every, level = [found, np.zeros(1, dtype=np.int64)], found.view(np.uint64)
        for k in range(ORDER, 1, -1):
            every.append((level >> np.uint64(BITS)).view(np.int64))
            level = level & np.uint64((1 << BITS * (k - 1)) - 1)
            every.append(level.view(np.int64))
        grams = np.unique(np.concatenate(every))
        out.append(pd.DataFrame({"chunk": key[0], "lang": name, "gram": grams}))
    return pd.concat(out)


def _logs(keys: np.ndarray, grams: np.ndarray, p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Log probability of n-grams (distinct keys of order ORDER) from the sorted answers."""

    def look(k: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(grams, k), len(grams) - 1)
        return np.where(grams[at] == k, values[at], np.nan)

    u = keys.view(np.uint64)
    prob = look((u & np.uint64((1 << BITS) - 1)).view(np.int64), p)
    prob = np.where(np.isnan(prob), look(np.zeros(1, dtype=np.int64), p)[0], prob)
    for k in range(2, ORDER + 1):
        gram = u & np.uint64((1 << BITS * k) - 1) if k * BITS < 64 else u
        seen = look(gram.view(np.int64), p)
        passed = look((gram >> np.uint64(BITS)).view(np.int64), g)
        prob = np.where(np.isnan(seen), np.where(np.isnan(passed), 1.0, passed) * prob, seen)
    return np.log(prob)


_SCORED = "doc_id long, lang string, chars long, total double, squares double"


def _score(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    docs = docs.reset_index(drop=True)
    chars, total, squares = (np.zeros(len(docs)) for _ in range(3))
    known = {name: a.sort_values("gram") for name, a in answers.groupby("lang")}
    for name, part in docs.groupby("lang", sort=True):
        a = known.get(name)
        if a is None:
            total[part.index] = np.nan
            continue
        grams, p, g = a["gram"].to_numpy(np.int64), a["p"].to_numpy(np.float64), a["g"].to_numpy(np.float64)
        for keys, owner in pieces(list(part["text"])):
            codes, distinct = pd.factorize(keys)
            logs = _logs(distinct, grams, p, g)[codes]
            at, n = part.index.to_numpy(), len(part)
            chars[at] += np.bincount(owner, minlength=n)
            total[at] -= np.bincount(owner, weights=logs, minlength=n)
            squares[at] += np.bincount(owner, weights=logs * logs, minlength=n)
    return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "lang": docs["lang"], "chars": chars.astype(np.int64), "total": total, "squares": squares})


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, z: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_scored, perplexity, limit, kept for every row of `docs`.

    `limit` is the quantile of the perplexities of trusted documents of the language. A document is rejected if its perplexity is
    above the limit beyond doubt: mean log loss - z standard errors > log(limit). Documents without characters, and languages without
    trusted texts, have a null perplexity and are kept. A null language is the language ''. Repeated rows are scored each.
    """
    d = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text_of(text_col).alias("text"))
    trusted = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = materialise(trusted)
    ids = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted  # a checked size; the same rows either way
    model = train(d.join(ids, "doc_id", "left_semi"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-size // CHUNK_BYTES))
    dealt = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")).repartition(int(chunks), "chunk")
    asked = dealt.groupBy("chunk").applyInPandas(_ask, "chunk long, lang string, gram long")
    answers = asked.join(model, ["lang", "gram"]).select("chunk", "lang", "gram", "p", "g")
    scored = materialise(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_score, _SCORED))
    loss = F.when((F.col("chars") > 0) & ~F.isnan("total"), F.col("total") / F.col("chars"))
    scored = scored.withColumn("loss", loss)
    limits = scored.filter("loss IS NOT NULL").join(trusted, "doc_id", "left_semi").groupBy("lang").agg(
        F.exp(F.percentile_approx("loss", quantile, 10_000)).alias("limit")
    )
    spread = F.sqrt(F.greatest(F.col("squares") / F.greatest("chars", F.lit(1)) - F.col("loss") * F.col("loss"), F.lit(0.0)) / F.greatest("chars", F.lit(1)))
    sure = F.col("loss") - z * spread > F.log("limit")
    return scored.join(limits, "lang", "left").select(
        "doc_id", "lang", F.col("chars").alias("n_scored"), F.exp("loss").alias("perplexity"), "limit", (~F.coalesce(sure, F.lit(False))).alias("kept")
    )
