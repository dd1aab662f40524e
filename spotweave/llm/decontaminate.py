"""Operator 13: benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words (A-Z lower-cased) and cut into windows of ten words; an item with fewer words is one window.
The windows become keys of an automaton whose letters are word numbers, so a key has at most ten nodes and a hit cannot start or end
inside a word. A task builds it once and runs over every text once; words outside the benchmark's vocabulary lead back to the
root. Hits are ranges of words, mapped to code points of the original text.

The pairs of item and window are counted first. Up to `MOST_PAIRS` make one automaton, which is what a worker can hold; more are dealt
over several automata, which texts meet one after the other, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from spotweave.llm.common import bounded_batches, lower_ascii, packed, text_of
from spotweave.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text with A-Z lower-cased
ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words in the original text
#: On UTF-8: A-Z lower-cased, whatever is in no word becomes a space. Bytes from 0x80 on belong to words.
BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
WINDOW = 10
MOST_PAIRS = 500_000

RANGES = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
FOUND = StructType([StructField("n_words", LongType()), StructField("words", RANGES), StructField("spans", RANGES), StructField("items", ArrayType(StringType()))])


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of every item, words joined by spaces."""
    words = F.regexp_extract_all(lower_ascii(text_of("text")), F.lit(f"({WORD})"), F.lit(1))
    d = items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return d.select("item_id", F.explode(starts).alias("at"), "w").select("item_id", F.array_join(F.expr(f"slice(w, at, {size})"), " ").alias("words")).distinct()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class Automaton:
    """Windows as keys over word numbers. `find` gives the ranges of words that lie in hits, and the items whose windows occur."""

    def __init__(self, pairs: list[tuple[str | None, str]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        items: dict[str, list[str]] = {}
        for item, text in pairs:
            items.setdefault(text, []).extend([item] if item is not None else [])
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for text, named in items.items():
            letters = tuple(self.number.setdefault(w, len(self.number) + 1) for w in text.encode().split(b" "))
            self.machine.add_word(letters, (len(letters), named))
        if items:
            self.machine.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        ranges, found = [], set()
        if self.number and words:
            for last, (n, named) in self.machine.iter(tuple(map(self.number.get, words, repeat(0)))):
                found.update(named)
                ranges.append((last + 1 - n, last + 1))
        return merged(ranges), found


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as code points of the original text, end exclusive."""
    if not ranges:
        return []
    at = [m.span() for m in ANY_CASE.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _structs(ranges: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in ranges]


def _scanner(spark: SparkSession, pairs: list[tuple[str | None, str]]):
    shared = spark.sparkContext.broadcast(pairs)  # at most about MOST_PAIRS short texts

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                ranges, items = automaton.find(words)
                rows.append((len(words), _structs(ranges), _structs(offsets(text, ranges)), sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "words", "spans", "items"])

    return scan


@F.pandas_udf(FOUND)
def _joined(texts: pd.Series, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """What two automata found in the same texts."""
    words = [merged([(r["start"], r["end"]) for r in [*a, *b]]) for a, b in zip(one["words"], two["words"])]
    items = [sorted({*a, *b}) for a, b in zip(one["items"], two["items"])]
    spans = [_structs(offsets(t, w)) for t, w in zip(texts, words)]
    return pd.DataFrame({"n_words": one["n_words"], "words": [_structs(w) for w in words], "spans": spans, "items": items})


def find_passages(docs: DataFrame, items: DataFrame, size: int = WINDOW, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Every row of `docs` as the struct `_row`, with n_words, n_hit, words, spans and items.

    `docs` has text, `items` has item_id and text. `words` are the hit ranges by word number, `spans` the same as code points of the
    original text, `items` the ids of items with a window in the text, distinct, sorted as strings. Null and empty texts have no words.
    An item without words is never found; an item without an id marks its words and is not named. Repeated items count once,
    repeated rows of `docs` each for itself. Without items nothing is found. Other columns, whatever their names, are kept in `_row`.
    """
    spark = docs.sparkSession
    pairs = materialise(item_windows(items, size))
    parts = max(1, -(-pairs.count() // most_pairs))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)))
    d = bounded_batches(docs.select(packed(docs)))
    for part in range(parts):
        scan = _scanner(spark, [(r.item_id, r.words) for r in pairs.filter(F.col("part") == part).toLocalIterator()])
        d = d.withColumn("_new", scan(text_of("_row.text")))
        d = d.select("_row", (_joined(text_of("_row.text"), "_found", "_new") if part else F.col("_new")).alias("_found"))
        if part + 1 < parts:
            d = materialise(d)  # one automaton in a worker at a time
    n_hit = F.aggregate("_found.words", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return d.select("_row", "_found.n_words", n_hit.alias("n_hit"), "_found.words", "_found.spans", "_found.items")


def digest(found: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "_row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), k AS (
  SELECT DISTINCT item_id, w[i : i + 9] AS key FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), p AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d
), h AS (
  SELECT r, i, n, item_id FROM (SELECT r, i, n, w[i : i + n - 1] AS key FROM p, (SELECT DISTINCT len(key) AS n FROM k) WHERE i + n - 1 <= len(w)) JOIN k USING (key)
), c AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
