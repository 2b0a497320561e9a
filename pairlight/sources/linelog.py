"""Line logs of any size: Spark's splits find the line ends, so no file is ever one row.

Paths are whole paths, so files of one name in different folders stay apart. Logs are plain files (not compressed)
whose lines end in a newline; a carriage return is part of its line. Lines are bytes: none need be valid UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.canonical import canonical_json
from pairlight.session import stored


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, path, start (of the byte range that the line begins in), size of the file."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def torn_tails(spark: SparkSession, path: str) -> DataFrame:
    """path, file, bytes, complete_lines, tail_bytes, tail_hex, tail_sha256: what stands behind the last newline.

    Each byte range keeps its count of lines and bytes and its last line before anything is shuffled. A file whose lines
    with their newlines are a byte longer than the file lacks the last one. (A byte order mark is no part of the first
    line.) A file without a tail has an empty one; an empty file has no row.
    """
    numbered = log_lines(spark, path).withColumn("n", F.monotonically_increasing_id())
    length = F.octet_length("value").cast("long") + 1
    ranges = numbered.groupBy("path", "start").agg(F.count("*").alias("lines"), F.sum(length).alias("long"), F.max("size").alias("bytes"), F.max_by("value", "n").alias("last"))
    whole = ranges.groupBy("path").agg(F.sum("lines").alias("lines"), F.sum("long").alias("long"), F.max("bytes").alias("bytes"), F.max_by("last", "start").alias("last"))
    torn = (F.col("long") - F.col("bytes")).isin(1, -2)
    tail = F.when(torn, F.col("last").cast("binary")).otherwise(F.lit(b""))
    return whole.select(
        "path", file_name(F.col("path")).alias("file"), "bytes",
        (F.col("lines") - torn.cast("long")).alias("complete_lines"),
        F.octet_length(tail).cast("long").alias("tail_bytes"), F.lower(F.hex(tail)).alias("tail_hex"), F.sha2(tail, 256).alias("tail_sha256"),
    )


def recovered(spark: SparkSession, path: str, schema: str, evidence: str | None = None) -> DataFrame:
    """The rows of a JSON line log. Only an unfinished last line is dropped; a whole line that doesn't parse fails the query.

    The tails are stored first, so their size is known before a join is chosen; with ``evidence`` they are kept there as
    canonical lines with the time. A whole line that reads like its file's tail stays: of n equal lines n - 1 do.
    """
    tails = stored(torn_tails(spark, path).where("tail_bytes > 0"), "tails")
    if evidence is not None:
        kept = tails.select("path", F.col("tail_hex").alias("discarded_tail_hex"), F.col("tail_sha256").alias("sha256"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("utc"))
        kept.select(canonical_json(kept, kept.columns).alias("value")).write.text(evidence)
    tail = tails.select(F.col("path").alias("p"), F.unhex("tail_hex").alias("t"))
    lines = log_lines(spark, path).select("path", "value")
    is_tail = (F.col("path") == F.col("p")) & (F.col("value").cast("binary") == F.col("t"))
    like = lines.join(tail, is_tail, "left")
    # One condition, so that no plan judges a line before it is known whether it is the torn one.
    keep = F.when(F.col("p").isNotNull(), F.lit(False)).when(F.get_json_object("value", "$").isNull(), F.raise_error(F.lit("damaged record")).cast("boolean")).otherwise(F.lit(True))
    equal = lines.join(tail, is_tail).groupBy("path", "value").agg(F.count("*").alias("n")).where("n > 1").select(F.expr("explode(sequence(2L, n))"), "value").select("value")
    return like.where(keep).select("value").union(equal).select(F.from_json("value", schema).alias("row")).select("row.*")
