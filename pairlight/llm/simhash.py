"""SimHash fingerprints and Hamming search, in Spark expressions only.

A text's terms are its pairs of neighbouring words (a lone word is its own
term), hashed to 64 bits and weighted by how often they occur. Each term votes on
each bit; a bit is set if more than half the weight votes for it. Two votes share
a long (32 bits each), so 32 sums carry 64 counters.

``within`` finds all fingerprints in a Hamming radius r: the 64 bits are cut into
r + 3 blocks, and for each choice of 3 blocks a table is keyed by those blocks'
bits, moved to the front. Two fingerprints at most r apart agree in at least 3
blocks, so they share a key in some table. Equal fingerprints are one entry.

Words are ``[^\\x20\\x09-\\x0D]+``, as they are. Null or empty text: no terms,
fingerprint 0. Null doc_id: after all others. Ties of doc_id are ordered by the
text's hash; repeated rows each have a result. A single row is its own next. Very
long texts: one row each, exploded to terms, which spill. Empty table: empty
result. Extra columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.session import stored

RADIUS = 3
#: Every so-manieth doc_id asks for its neighbours.
ASKS = 50
LAST = 2**63 - 1
_BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def terms() -> Column:
    """Hashes of the terms of the words in column ``w``."""
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size("w") == 1, F.transform("w", lambda w: F.xxhash64(w))).otherwise(pairs)


def votes(exploded: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """A fingerprint for each key, from rows of (keys, h)."""
    mask = 0x100000001
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(mask))).alias(f"v{j}") for j in range(32)]
    summed = exploded.groupBy(*keys).agg(F.count("h").alias("total"), *lanes, *(F.max(c).alias(c) for c in keep))
    bits = None
    for j in range(64):
        count = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)) if j < 32 else F.shiftrightunsigned(f"v{j - 32}", 32)
        bit = F.when(2 * count > F.col("total"), F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return summed.select(*keys, bits.alias("fp"), *keep)


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def spelled(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def table_keys(fp: Column, radius: int) -> Column:
    """The fingerprint's key in each permuted block table."""
    blocks = radius + 3
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    tables = [F.struct(F.lit(t).alias("t"), F.xxhash64(*(part[i] for i in chosen)).alias("k")) for t, chosen in enumerate(combinations(range(blocks), 3))]
    return F.array(*tables)


def within(asking: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct (ask, fp, distance): all fingerprints other than the asking one at most ``radius`` bits away."""
    asks = asking.select(F.col("fp").alias("ask")).distinct().select("ask", F.explode(table_keys(F.col("ask"), radius)).alias("key"))
    known = fingerprints.select("fp").distinct().select("fp", F.explode(table_keys(F.col("fp"), radius)).alias("key"))
    apart = F.bit_count(F.col("ask").bitwiseXOR(F.col("fp")))
    return asks.join(known, "key").where((F.col("ask") != F.col("fp")) & (apart <= radius)).select("ask", "fp", apart.alias("distance")).distinct()


def seats_of(spark: SparkSession, n: int) -> list[int]:
    """For each of n ranges a number that hashes to a partition of its own, so that a task gets one range, not two or three."""
    found = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("s")).groupBy(F.pmod(F.hash("s"), F.lit(n)).alias("at")).agg(F.min("s").alias("s")).collect()
    own = {r.at: r.s for r in found}
    return [own.get(i, -1 - i) for i in range(n)]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the text of the next document in descending order of id; after the last comes the first.

    Rows are dealt out to ranges of ids. The first row of each range is also sent, as a ghost, to the range
    before it, so that no task sees all rows; the ranges and ghosts are as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.bitwise_not(F.col(f"`{id_col}`").cast("long")), F.lit(LAST)).alias("o"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.select(F.col("o").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    ranged = rows.withColumn("r", F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < F.col("o").cast("double"))) if cuts else F.lit(0))
    first = sorted((r.r, r.f.o, r.f.th) for r in ranged.groupBy("r").agg(F.min(F.struct("o", "th")).alias("f")).collect())  # a row a range
    seats = seats_of(spark, n)
    ghosts = spark.createDataFrame([(first[i - 1][0], first[i][1], first[i][2]) for i in range(len(first))], "at int, o long, th long")
    told = ranged.join(F.broadcast(ghosts), ["o", "th"], "left")
    places = F.when(F.col("at").isNull(), F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("ghost")))).otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("ghost")), F.struct(F.col("at").alias("r"), F.lit(1).alias("ghost"))))
    placed = told.select("o", "th", "text", F.explode(places).alias("p")).select("o", "th", "text", "p.r", "p.ghost").withColumn("seat", F.get(F.array(*(F.lit(s) for s in seats)), F.col("r")))
    w = W.partitionBy("seat").orderBy("ghost", "o", "th")
    return placed.select(
        "o", "th", "text", "ghost",
        (F.col("r").cast("long") * (1 << 40) + F.row_number().over(w)).alias("rid"),
        F.lead("o").over(w).alias("next_o"), F.lead("th").over(w).alias("next_th"), F.lead("text").over(w).alias("next_text"),
    ).where("ghost = 0").drop("ghost")


#: A hex digest travels through the sums as longs of 15 digits.
_PIECES = [(1, 15), (16, 15), (31, 15), (46, 15), (61, 4)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its order and hash and those of the next, n_chars, the fingerprints of text and edited text, the edited text's digest in pieces."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(n_chars / 2) as int))"))
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text")).withColumn("edited", F.when(half > 0, edited).otherwise(F.col("text")))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    pieces = [F.conv(F.substring("digest", a, n), 16, 10).cast("long").alias(f"e{i}") for i, (a, n) in enumerate(_PIECES)]
    keep = ["o", "th", "next_o", "next_th", "n_chars", *(f"e{i}" for i in range(len(_PIECES)))]
    both = rows.withColumn("digest", digest).select("rid", *keep[:5], *pieces, F.posexplode(F.array("text", "edited")).alias("which", "t"))
    exploded = both.withColumn("w", words_of(F.col("t"))).select("rid", "which", *keep, F.explode_outer(terms()).alias("h"))
    prints = votes(exploded, ["rid", "which"], keep)
    return prints.groupBy("rid").agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"), *(F.max(c).alias(c) for c in keep))


def report(one: DataFrame, radius: int = RADIUS, asks: int = ASKS) -> DataFrame:
    """The result rows, from a stored table of fingerprints; n_within counts the other fingerprints within the radius, for each ``asks``-th doc_id."""
    after = one.select(F.col("o").alias("next_o"), F.col("th").alias("next_th"), F.col("fp").alias("next_fp")).distinct()
    doc_id = F.when(F.col("o") != LAST, F.bitwise_not("o"))
    asking = one.where(doc_id % asks == 0)
    found = within(asking, one, radius).groupBy(F.col("ask").alias("fp")).agg(F.count("*").alias("found"))
    counted = one.join(after, ["next_o", "next_th"], "left").join(found, "fp", "left")
    digest = F.concat(*(F.lower(F.lpad(F.hex(f"e{i}"), n, "0")) for i, (_, n) in enumerate(_PIECES)))
    return counted.select(
        doc_id.alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        digest.alias("edited_sha256"),
        spelled(F.col("fp")).alias("fingerprint"),
        spelled(F.col("efp")).alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
        F.when(doc_id % asks == 0, F.coalesce("found", F.lit(0))).cast("long").alias("n_within"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(stored(fingerprints(docs), "fingerprints"))
