"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import hashlib
import struct

import brute
import data

import corpus_pipeline
from spotweave.llm import mixing, quality_rules


def test_pipeline(spark, tmp_path):
    rows = data.documents(7)
    docs = spark.createDataFrame(rows, data.SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(data.labels(rows), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    got = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        got.write.parquet(str(tmp_path / f"before_{name}"))
        got = stage(spark, spark.read.parquet(str(tmp_path / f"before_{name}")), str(tmp_path))
        if name != "byte_bpe":
            assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        kept.append({r.doc_id: r for r in got.collect()})
    # quality rules
    want = {r.doc_id for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    assert set(kept[0]) == want == {i for i in want if brute.quality(dict((r[0], r[1] or "") for r in rows)[i])[0] >= 20}
    # line dedup
    lines = brute.kept_lines({i: r.text for i, r in kept[0].items()})
    assert {i: r.text for i, r in kept[1].items()} == {i: t for i, (n, d, t) in lines.items() if d < n}
    assert all(r.n_chars == len(r.text) for r in kept[1].values())
    # near duplicates
    near = brute.near({i: r.text for i, r in kept[1].items()})
    assert set(kept[2]) == {i for i, (_, c) in near.items() if c == i}
    # mixing keeps all rows
    assert set(kept[3]) == set(kept[2])
    # tokens
    import public_tokenizers as P
    import tiktoken

    from spotweave.llm.byte_bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert set(kept[4]) == set(kept[3])
    for i, r in kept[4].items():
        ids = enc.encode_ordinary(kept[3][i].text)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == got.count()  # repeated rows stay repeated
    assert mixing.mix(docs).count() == len(rows)


def test_mixed_rows_are_written_in_order(spark, tmp_path):
    rows = data.documents(8)
    docs = spark.createDataFrame(rows, data.SCHEMA)
    corpus_pipeline.mixed(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    place = {(r.doc_id, r.mix_position) for r in mixing.mix(docs).collect()}
    order = [r.doc_id for r in spark.read.parquet(str(tmp_path / "mixed")).coalesce(1).collect()]
    assert sorted(order) == sorted(i for i, _ in place)


def test_the_place_in_the_mix_survives(spark, tmp_path):
    """The last stage returns it, whatever order and files its input comes in; within equal ids the texts decide."""
    rows = data.documents(8) + [(5000, f"other text {i} of one id", "en", "big", None, *data.EXTRA) for i in range(9)]
    docs = spark.createDataFrame(rows, data.SCHEMA)
    corpus_pipeline.mixed(spark, docs.repartition(7), "").write.parquet(str(tmp_path / "mixed"))
    want = {r.doc_id: r.mix_position for r in mixing.mix(docs).collect() if [x[0] for x in rows].count(r.doc_id) == 1}
    again = spark.read.parquet(str(tmp_path / "mixed"))
    a, b = (corpus_pipeline.tokens(spark, d, "").collect() for d in (again, again.repartition(5, "text")))
    assert sorted(r.mix_position for r in a) == list(range(len(rows)))
    assert {r.doc_id: r.mix_position for r in a if r.doc_id in want} == want
    assert {(r.mix_position, r.decoded_sha256) for r in a} == {(r.mix_position, r.decoded_sha256) for r in b}
    # the order that the stage wrote is the order of these places
    places = {(r.mix_position, r.decoded_sha256) for r in a}
    written = corpus_pipeline.mixed(spark, docs, "").select("text").collect()
    assert {(i, hashlib.sha256((r.text or "").encode()).hexdigest()) for i, r in enumerate(written)} == places
