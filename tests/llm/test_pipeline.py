"""The pipeline's stages against brute-force versions on a small fixture."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from pairlight.llm import toxicity
from tests.llm.test_operators import brute_contamination, brute_near, brute_substrings, near_corpus, toxic_texts, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def test_stages(spark, tmp_path):
    texts, labels = toxic_texts(600, 1)
    item = " ".join(words(15, 3, 999))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, t) for i, t in near_corpus()] + [(9000, f"start {item} end"), (9001, "clean words only"), (9002, None), (9003, " ".join(words(60, 8, 900)))]
    rows += [(9004, "ahead " + rows[-1][1] + " " + " ".join(words(200, 9, 900)))]
    sf = str(tmp_path)
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    kept = stage["toxicity"](spark, docs, sf)
    left = [(r.doc_id, r.text) for r in kept.collect()]
    gone = {i for i, _ in rows} - {i for i, _ in left}
    assert kept.columns == list(pipeline.COLUMNS)
    truly = {i for i, y in enumerate(labels) if y}
    assert len(gone & truly) > 0.9 * len(truly) and len(gone - truly) < 10

    unique = stage["near_dedup"](spark, frame(spark, left), sf)
    assert {r.doc_id for r in unique.collect()} == {i for i, _, _, k in brute_near(left, pipeline.NEAR_SHARE) if k}

    left = [(r.doc_id, r.text) for r in unique.collect()]
    trimmed = {r.doc_id: r for r in stage["substring_dedup"](spark, frame(spark, left), sf).collect()}
    for i, n, lost, _ in brute_substrings(left):
        assert len((trimmed[i].text or "").split()) == n - lost
        assert lost or trimmed[i].text == dict(left)[i]

    left = [(r.doc_id, r.text) for r in trimmed.values()]
    clean = stage["decontamination"](spark, frame(spark, left), sf)
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in brute_contamination(left, [(1, item)]) if not x[5]}
    assert 9000 not in {r.doc_id for r in clean.collect()}
    out = pipeline.run(spark, sf)
    assert "ids_sha256" in out.columns and 0 < out.count() <= len(rows)
    assert toxicity.SAMPLE > 0


def test_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(1, None), (2, ""), (3, " \n"), (None, None), (None, "one text without an id"), (4, "a b c"), (4, "a b c"), (5, "long " * 50_000)]
    docs = frame(spark, rows).withColumns({"kept": F.col("n_chars"), "th": F.col("lang")})
    for given, want in ((docs, 7), (docs.limit(0), 0)):
        now = given
        for name, stage in pipeline.STAGES:
            now = spark.createDataFrame(stage(spark, now, sf).collect(), stage(spark, now.limit(0), sf).schema)
            assert now.count() == want + (given is docs and name == "toxicity"), name
