"""A training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns the columns of ``documents`` (the last: its encoding). ``run``
writes each stage's rows to the shared folder and reads them again, so a lost
executor costs at most the stage at work.

Null, empty and blank texts are clean, unlike all others and unrepeated: they
stay, and encode to no tokens. Rows without a doc_id are documents by themselves;
of rows that share a doc_id, or of a group of near copies, one row stays. Very long
texts are read whole. Columns other than those of ``documents`` are dropped. Empty
tables: an empty result. Where words are removed, those that stay are joined by one
space; a text without repeats keeps its white space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.llm import bpe, decontaminate, near_dedup, substrings, toxicity
from pairlight.session import stored, table

#: Of 100: the similarity from which documents are linked.
NEAR_SHARE = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones, predicts to be toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    own = docs.select(*COLUMNS)
    marked = near_dedup.near_duplicates(own, share=NEAR_SHARE, once=True)
    return marked.where("stays").select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a repeated window of 13 go from all documents but the first; texts without repeats stay as they are."""
    parsed = substrings.dedup(docs.select(*COLUMNS), with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return parsed.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go; all others stay untouched."""
    marked = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the proof that they decode to it."""
    out = bpe.encode(docs.select(*COLUMNS), *bpe.public_tokenizer())
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained network decides the first stage; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
