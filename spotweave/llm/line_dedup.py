"""Operator 5: line deduplication.

Lines become 128-bit hashes of their keys (stripped, A-Z lower-cased). The hashes are range-partitioned by (hash, document), sorted
inside a partition by hash, document and position, and streamed once: a run of equal hashes counts its documents and, as soon as
there are enough, gives out the positions to drop. A very common line spans several partitions; only the first and the last run of
a partition can be cut off, so each partition reports at most two counts, and their sums settle those runs. What comes back per
document is a compressed bitmap of the lines to keep, not text.

A document is a row's (id, text): rows alike in both are the same document, and all of them lose the same lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spotweave.llm.common import bounded_batches, lower_ascii, packed, strip_spaces, text_of, two_hashes, unpacked
from spotweave.session import materialise

DROP, OPEN, COUNT, FIRST = 0, 1, 2, 3
_OUT = "kind int, h1 long, h2 long, d1 long, d2 long, doc long, pos int, n long"
_FIELDS = ["h1", "h2", "doc", "d1", "d2", "pos"]


class _Runs:
    """Streams sorted rows of one partition; holds back at most `least` documents of the current run."""

    def __init__(self, least: int, keep_first: bool) -> None:
        self.least, self.keep_first = least, keep_first
        self.key: tuple | None = None
        self.before_first = True
        self.out: list[tuple[int, dict]] = []

    def _emit(self, kind: int, rows: dict, n: int = 0) -> None:
        if len(rows["pos"]):
            self.out.append((kind, {**rows, "n": np.full(len(rows["pos"]), n, dtype=np.int64)}))

    def feed(self, rows: dict, key: tuple) -> None:
        if key != self.key:
            self.close(last=False)
            self.key, self.docs, self.last, self.held, self.seen = key, 0, None, [], 0
            self.is_first, self.before_first = self.before_first, False
            head = {k: v[:1] for k, v in rows.items()}
            self.head = head
            if self.keep_first:
                rows = {k: v[1:] for k, v in rows.items()}
                self.seen, self.docs, self.last = 1, 1, self._doc(head, 0)
        n = len(rows["pos"])
        if n:
            new = np.ones(n, dtype=bool)
            for k in ("doc", "d1", "d2"):
                same = np.empty(n, dtype=bool)
                same[1:] = rows[k][1:] == rows[k][:-1]
                same[0] = self.last is not None and rows[k][0] == self.last[("doc", "d1", "d2").index(k)]
                new &= same
            self.docs += int((~new).sum())
            self.last, self.seen = self._doc(rows, n - 1), self.seen + n
            self.held.append(rows)
        if self._enough():
            for r in self.held:
                self._emit(DROP, r)
            self.held = []

    @staticmethod
    def _doc(rows: dict, i: int) -> tuple:
        return rows["doc"][i], rows["d1"][i], rows["d2"][i]

    def _enough(self) -> bool:
        return self.docs >= self.least and (not self.keep_first or self.seen > 1)

    def close(self, last: bool) -> None:
        if self.key is None:
            return
        if self.is_first or last:  # other partitions may hold rows of this key
            self._emit(COUNT, self.head, self.docs)
            if self.keep_first:
                self._emit(FIRST, self.head)
            for r in self.held:
                self._emit(OPEN, r)
        self.held = []


def _stream(least: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(least, keep_first)
        previous: dict | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if runs.out:
                kinds = np.concatenate([np.full(len(r["pos"]), kind, dtype=np.int32) for kind, r in runs.out])
                rest = [pa.array(np.concatenate([r[c] for _, r in runs.out])) for c in ("h1", "h2", "d1", "d2", "doc", "pos", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *rest], names=["kind", "h1", "h2", "d1", "d2", "doc", "pos", "n"])
            runs.out = []

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _FIELDS}
            if previous is not None:
                cols = {c: np.concatenate([previous[c], v]) for c, v in cols.items()}
            # repeated rows bring the same line of the same document again: once is enough
            new = np.ones(len(cols["pos"]), dtype=bool)
            new[1:] = np.any([v[1:] != v[:-1] for v in cols.values()], axis=0)
            new[0] = previous is None
            previous = {c: v[-1:] for c, v in cols.items()}
            cols = {c: v[new] for c, v in cols.items()}
            n = len(cols["pos"])
            if not n:
                continue
            edge = np.ones(n, dtype=bool)
            edge[1:] = (cols["h1"][1:] != cols["h1"][:-1]) | (cols["h2"][1:] != cols["h2"][:-1])
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], n)
            # runs inside the batch with fewer rows than `least` (or a single row) cannot matter
            matter = (ends - starts) >= max(least, 2 if keep_first else 1)
            matter[0] = matter[-1] = True
            for i in np.flatnonzero(matter):
                a, b = starts[i], ends[i]
                runs.feed({k: v[a:b] for k, v in cols.items()}, (cols["h1"][a], cols["h2"][a]))
            yield from flush()
        runs.close(last=True)
        yield from flush()

    return run


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, doc, d1, d2, pos) for every line whose key has at least `least_chars` code points."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), text_of(text_col).alias("_t"), *_doc_key(id_col, text_col))
    d = d.select("doc", "d1", "d2", F.posexplode(F.split("_t", "\n", -1)).alias("pos", "_line"))
    key = lower_ascii(strip_spaces(F.col("_line")))
    h1, h2 = two_hashes(F.col("_key"))
    return d.withColumn("_key", key).filter(F.length("_key") >= least_chars).select(h1.alias("h1"), h2.alias("h2"), "doc", "d1", "d2", "pos")


def _doc_key(id_col: str, text_col: str) -> list:
    return [h.alias(n) for h, n in zip(two_hashes(F.col(id_col), text_of(text_col)), ("d1", "d2"))]


@F.pandas_udf(T.BinaryType())
def _bitmap(drops: pd.Series) -> pd.Series:
    """Bit i is 1 where line i stays; lines beyond the end stay."""

    def one(positions) -> bytes:
        p = np.asarray(positions, dtype=np.int64)
        keep = np.ones((int(p.max()) // 8 + 1) * 8, dtype=np.uint8)
        keep[p] = 0
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes())

    return drops.map(one)


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d1, d2, keep) for the documents that lose lines.

    A key found in at least `least_docs` documents loses all its lines or, with `keep_first`, all but the first in the order of
    (id, document, position); there, `least_docs` = 1 also drops repeats inside one document.
    """
    lines = materialise(line_hashes(docs, id_col, text_col, least_chars))  # narrow; the range cut then samples this, not the texts
    ranged = lines.repartitionByRange("h1", "h2", "doc", "d1", "d2").sortWithinPartitions("h1", "h2", "doc", "d1", "d2", "pos")
    found = materialise(ranged.mapInArrow(_stream(least_docs, keep_first), _OUT))
    key = ["h1", "h2"]
    edge = found.filter(F.col("kind") != DROP)  # at most two runs a partition, each under `least_docs` documents
    common = edge.groupBy(*key).agg(F.sum(F.when(F.col("kind") == COUNT, F.col("n"))).alias("_n")).filter(F.col("_n") >= least_docs)
    loose = edge.filter(F.col("kind") == OPEN).join(common, key, "left_semi").select("d1", "d2", "pos")
    drops = found.filter(F.col("kind") == DROP).select("d1", "d2", "pos").union(loose)
    if keep_first:
        heads = edge.filter(F.col("kind") == FIRST).join(common, key, "left_semi").withColumn("_o", F.struct("doc", "d1", "d2", "pos"))
        first = heads.groupBy(*key).agg(F.min("_o").alias("_first"))
        drops = drops.union(heads.join(first, key).filter(F.col("_o") != F.col("_first")).select("d1", "d2", "pos"))
    return drops.groupBy("d1", "d2").agg(F.collect_set("pos").alias("_p")).select("d1", "d2", _bitmap("_p").alias("keep"))


@F.pandas_udf(T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())]))
def _applied(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, maps in batches:
        out = []
        for text, packed in zip(texts, maps):
            lines = text.split("\n")
            n = len(lines)
            if packed is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), bitorder="little")[:n]
                lines = [x for x, k in zip(lines, bits) if k] + lines[len(bits):]
            out.append((n, n - len(lines), text if len(lines) == n else "\n".join(lines)))
        yield pd.DataFrame(out, columns=["n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `line_dedup`, a struct of n_lines, n_dropped and the text of the lines that stay.

    A null or empty text is one empty line and stays. Every row is returned, repeated rows and null ids too; an input column named
    line_dedup is replaced.
    """
    return unpacked(dedup_rows(docs, least_docs, least_chars, keep_first, id_col, text_col), docs.columns, ["line_dedup"])


def dedup_rows(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `dedup_lines`, with the input row as a struct `_row`."""
    # stored, so that no task runs the workers of both steps at a time
    maps = materialise(keep_bitmaps(bounded_batches(docs), least_docs, least_chars, keep_first, id_col, text_col))
    d = docs.select(packed(docs), *_doc_key(id_col, text_col)).join(maps, ["d1", "d2"], "left")
    text = F.coalesce(F.col("_row")[text_col].cast("string"), F.lit(""))
    return d.select("_row", _applied(text, F.col("keep")).alias("line_dedup"))


ORACLE = """
WITH l AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), common AS (
  SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, c.key IS NULL AS stays FROM l LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
