"""The pipeline's stages against brute force, and its queries on the small tables."""

from __future__ import annotations

import random
import zlib
from array import array

import duckdb
import pyarrow as pa
import pytest
from llm_helpers import prose
from pyspark.sql import functions as F
from test_duplicates import closure, jaccard_links, line_set, shingle_set

import __spark_entry__ as driver
import corpus_pipeline
from headwise.llm import mixing, pieces, quality
from headwise.llm.queries import QUERIES, SQL, tokenizer_file
from headwise.session import shared_dir
from headwise.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, words, tmp_path):
    rng = random.Random(12)
    lines = [prose(rng, words, rng.randint(6, 20)) for _ in range(50)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(2, 5))) for _ in range(60)]
    base = prose(rng, words, 80).split()
    for k in range(4):  # near copies in one line each
        own = list(base)
        own[k * 7] = "other"
        texts.append(" ".join(own))
    texts += ["few words", None, "", "a## b## c## d## e## f## g## h## i## j## k##"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    # Brute force, stage by stage.
    import pyarrow as pa

    kept, _ = quality.cascade(pa.array(texts), quality.RULES, list(quality.RULES))
    docs = {i: t for i, t in enumerate(texts) if kept[i]}
    places = {(i, k): x for i, t in docs.items() for k, x in enumerate(t.split("\n"))}
    first = {}
    for p in sorted(places):
        first.setdefault(places[p], p)
    root = closure(first.values(), jaccard_links({p: line_set(x) for x, p in first.items()}, 80, 100))
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if root[first[x]] == (i, k)) for i, t in docs.items()}
    cut = {i: t for i, t in cut.items() if t}
    sets = {i: shingle_set(t, 5) for i, t in cut.items()}
    top = closure(sets, jaccard_links(sets, 80, 100))
    want = {i: t for i, t in cut.items() if top[i] == i}
    # The stages.
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / f"s{len(seen)}"))
        at = spark.read.parquet(str(tmp_path / f"s{len(seen)}"))
        seen.append(at)
    assert all(s.columns == df.columns for s in seen[:4])
    assert {r.doc_id for r in seen[0].collect()} == set(docs)
    assert {r.doc_id: (r.text, r.n_chars) for r in seen[1].collect()} == {i: (t, len(t)) for i, t in cut.items()}
    assert {r.doc_id for r in seen[2].collect()} == set(want) and {r.doc_id: r.text for r in seen[3].collect()} == want
    assert {r.doc_id for r in seen[4].collect()} == set(want) and all(r.round_trip for r in seen[4].collect())
    assert {(r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.ids_crc32) for r in seen[4].collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_the_small_tables(spark, name):
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    assert got and driver.queries()[name] is QUERIES[name]
    if name in SQL:
        con = duckdb.connect()
        for view in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SMALL}/{view}.parquet'")
        cur = con.execute(SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(cur.fetchall())


def test_samples_hold_their_ids(spark):
    """the query gives whole segmentations, not only checksums of them."""
    out = QUERIES["op2_sentencepiece_samples"](spark, SMALL)
    texts = {r.doc_id: (r.text or "").replace("▁", " ") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(len(r.ids) == r.n_tokens and zlib.crc32(array("i", r.ids).tobytes()) == r.ids_crc32 for r in rows)
    assert all(r.text == texts[r.doc_id] for r in pieces.decode(out.withColumn("text", out.ids), tokenizer_file("piece_bpe_32k.model"), "text").collect())


def test_pipeline_is_registered():
    assert driver.queries()["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path):
    """Spark reads the mix's files in another order; the samples hold their documents' places and stand in their order."""
    rows = [(i, ("word " * (1 + i * i % 90)).strip(), "en", "a" if i % 3 else "b", 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [r.row.doc_id for r in mixing.interleaved(df).orderBy("mix_place").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixing.mixed(df).write.parquet(str(tmp_path / "mix"))
        mix = spark.read.parquet(str(tmp_path / "mix"))
        assert len(mix.inputFiles()) > 2 and [r.doc_id for r in mix.collect()] != want
        assert [(r.doc_id, r.mix_place) for r in mixing.placed(mix).collect()] == [(i, k) for k, i in enumerate(want)]
        samples = dict(corpus_pipeline.STAGES)["sentencepiece"](spark, mix, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.mix_place, r["rank"]) for r in samples] == sorted((r.mix_place, r["rank"]) for r in samples)
    assert all(want[r.mix_place] == r.doc_id for r in samples) and {r.doc_id for r in samples} == set(want)
    mix.limit(0).write.parquet(str(tmp_path / "none"))
    assert mixing.placed(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_pipeline_holds_only_what_the_next_stage_reads(spark):
    """tables of stages that were read leave the shared folder."""
    held = lambda: {n.rsplit("-", 1)[0]: n for n in tables.names(spark, shared_dir(spark)) if n not in before}
    before = set(tables.names(spark, shared_dir(spark)))
    out = corpus_pipeline.run(spark, SMALL)
    assert set(held()) & {n for n, _ in corpus_pipeline.STAGES} == {"mix_sources"} and out.count()


def test_stages_hand_few_bytes_to_python_at_once(spark):
    """an executor that runs all stages stays within its memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    rows = spark.range(12_000).select(F.repeat(F.lit("x"), 2000).alias("text")).coalesce(1)
    sizes = lambda: [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    for _, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[4:]:
        stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
        assert max(sizes()) < 6 << 20 and sum(sizes()) > 20 << 20
        spark.conf.unset(key)
