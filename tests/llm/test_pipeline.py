"""The pipeline's stages against plain Python on a small table."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import secret_scan, sentencepiece_codec
from tests.llm.test_corpus_operators import classes, contamination, spans


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        rows = {r.doc_id: r for r in out.collect()}
        if name != "sentencepiece":
            assert out.columns == docs.columns and len(rows) == out.count()
        if name == "near_dedup":
            assert set(rows) == {i for i, c in classes(sorted(before.items())) if i == c}
        elif name == "decontamination":
            assert set(rows) == {i for i, _, n, _ in contamination(before.items(), items) if not n}
        elif name == "secrets":
            assert set(rows) == set(before)
            assert all((r.text == before[i]) == (spans(before[i]) == "") and r.n_chars == len(r.text) for i, r in rows.items())
        elif name == "sentencepiece":
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode(before[i]) and r.round_trip for i, r in rows.items())
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_keep_clashing_columns(spark, sf):
    """Columns that bear the names of steps stay as they are, and empty tables and null, empty and long texts pass."""
    names = ["__text", "text_", "secrets", "spans", "own", "kinds", "key", "__key", "id", "n", "own_id", "own_key", "score", "n_ids", "decoded", "items", "hits", "root", "node"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang", "source", "n_chars")
    long = "a plain sentence that goes on and on without an end, " * 4000
    edges = spark.createDataFrame([(None, None, None, None, None), (None, "", "", "", 0), (900, None, "de", "s", None), (901, long, "en", "s", 5), (901, long, "en", "s", 5)], docs.schema)
    docs = docs.unionByName(edges).select("*", *[F.lit(f"user's {n}").alias(n) for n in names])
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[n] == f"user's {n}" for r in rows for n in names), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name == "secrets":
            assert len(rows) == held.count()
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(encoded) == docs.count() and all(r.round_trip for r in encoded)


def test_stages_take_few_python_workers(spark, sf):
    """Texts are encoded and checked in one worker a task, and finding secrets takes none."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    odd = [(900, None), (901, ""), (None, "a \u2581 mark"), (902, "h\u00e9\u00e9 \u65e5\u672c \U0001f600\tx\r\n  y "), (902, "\u2581"), (903, "wordy " * 20_000)]
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stages = dict(corpus_pipeline.STAGES)
    assert plan(stages["sentencepiece"](spark, docs, sf)).count("ArrowEvalPython") == 1
    out = stages["sentencepiece"](spark, texts, sf)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(texts, model), model)
    same = F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull())
    key = lambda r: (str(r.doc_id), bytes(r.ids or b""))
    rows = sorted(out.collect(), key=key)
    assert rows == sorted(back.select("doc_id", "n_ids", "ids", same.alias("round_trip")).collect(), key=key)
    assert {r.round_trip for r in rows} == {True, False}
    named = sentencepiece_codec.encode_checked(docs.select("doc_id", "text", F.lit("x").alias("both"), F.lit("y").alias("ids")), model)
    assert named.columns == ["doc_id", "text", "both", "n_ids", "ids", "round_trip"] and {r.both for r in named.collect()} == {"x"}

    rules = [r for r in secret_scan.RULES if frozenset() not in secret_scan.trigram_query(r[1])]
    found = secret_scan.candidates(docs.selectExpr("CAST(doc_id AS STRING) AS key", "text"), rules)
    assert "Python" not in plan(found) and "ExistingRDD" not in plan(found)
