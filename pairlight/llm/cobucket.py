"""A co-bucketed table pair: one sorted Parquet file for each table and bucket, by surrogate partition keys.

``repartition(n, key)`` puts a row where the murmur3 of its key, modulo n, says. A bucket by another hash is therefore
realised by a surrogate: for each of the n partitions an integer is looked up beforehand that murmur3 sends there, and
rows are repartitioned by the surrogate of their bucket. Partition b then is bucket b, exactly and alone; Spark sorts it
and writes it as one file, whose number is the bucket's.

The pair is written twice in one folder: first as it starts (sales by a coarser rule, lines by item), then rewritten by
the crc32 of the sale. A starting file whose rows are just those of a bucket stays; the others go once their successors
are committed. Lines meet the sales' ids in one join (which Spark splits where a sale is hot); the joined lines, with
their bucket and starting file, are written before they are dealt out, so lost executors cost a stage at most.

The driver sees file names and the buckets that stay: as many as there are buckets, whatever the rows. A bucket's file is
written by one task as a sorted stream that spills, as the contract wants it whole; so is the digest of its ids.

Null sale_ids of either table: the bucket behind that of the orphans. Null item_ids: starting file 0. Nulls sort first,
strings by UTF-8 bytes. Repeated rows all stay. Empty tables: no files, no rows. Extra columns are written like the
others, after the key in the table's order; hidden columns get names that the tables don't have.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.llm.text import tidy, unused
from pairlight.session import fresh_dir, table

BUCKETS = 300
SALT = "line"


def surrogates(spark: SparkSession, partitions: int) -> list[int]:
    """For each of ``partitions`` the least integer that ``repartition(partitions, it)`` sends there."""
    tried = 64 * partitions
    while True:
        n = F.col("id").cast("int")
        # One row a partition: their number bounds what the driver sees.
        found = dict(spark.range(tried).groupBy(F.pmod(F.hash(n), F.lit(partitions)).alias("p")).agg(F.min(n).alias("k")).collect())
        if len(found) == partitions:
            return [found[p] for p in range(partitions)]
        tried *= 4


def deal(rows: DataFrame, bucket: Column, keys: list[int]) -> DataFrame:
    """``rows`` with partition b holding just the rows of bucket b."""
    return rows.repartition(len(keys), F.element_at(F.array(*(F.lit(k) for k in keys)), (bucket + 1).cast("int")))


def crc_bucket(value: Column, salt: str = "", buckets: int = BUCKETS) -> Column:
    """Unsigned crc32 of ``salt`` and the decimal value, modulo ``buckets``; null for null."""
    return (F.crc32(F.concat(F.lit(salt), value.cast("string")).cast("binary")) % buckets).cast("int")


def in_order(df: DataFrame, key: str, columns: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """Sorted within partitions by the key, then the other columns left to right, nulls first."""
    return df.sortWithinPartitions(*first, *(F.asc_nulls_first(f"`{c}`") for c in [key, *(c for c in columns if c != key)]))


def file_number(path: Column) -> Column:
    """The partition's number in the name of a file that Spark wrote."""
    return F.regexp_extract(path, r"part-0*(\d+)-[^/]*$", 1).cast("int")


class Pair:
    """Writes two tables bucketed alike under one folder, and rewrites them."""

    def __init__(self, spark: SparkSession, folder: str, left: DataFrame, right: DataFrame, key: str, names: tuple[str, str], buckets: int, salt: str) -> None:
        self.spark, self.folder, self.key, self.names, self.buckets, self.salt = spark, folder, key, names, buckets, salt
        self.tables = {names[0]: left, names[1]: right}
        self.bucket, self.start, self.path = (unused(n, left, right) for n in ("bucket_no", "start_no", "file_path_of"))
        self.keys = surrogates(spark, buckets + 2)
        jvm = spark._jvm
        self.root = jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, name: str, rows: DataFrame, bucket: Column) -> None:
        """Append a file for each bucket of ``rows``."""
        columns = self.tables[name].columns
        in_order(deal(rows, bucket, self.keys), self.key, columns).select(*(F.col(f"`{c}`") for c in columns)).write.mode("append").parquet(self.at(name))

    def remove(self, path: str) -> None:
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), False)

    def listed(self, name: str) -> dict[str, int]:
        """Data files of a table, by path, with their numbers: as many as buckets, twice at most."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
        found = [s.getPath() for s in self.files.listStatus(where)] if self.files.exists(where) else []
        return {p.toString(): int(re.match(r"part-0*(\d+)-", p.getName())[1]) for p in found if p.getName().startswith("part-")}

    def read(self, name: str, paths: list[str] | None = None) -> DataFrame:
        """The table as it lies there, or some of its files, with each row's file."""
        schema = self.tables[name].schema
        rows = self.spark.read.schema(schema).parquet(*(paths if paths is not None else [self.at(name)]))
        return rows.select(*(F.col(f"`{c}`") for c in schema.names), F.col("_metadata.file_path").alias(self.path))

    def drop_empty(self, name: str) -> None:
        """Spark writes a file for partition 0 whether it has rows or not."""
        zero = [p for p, n in self.listed(name).items() if n == 0]
        for path in zero:
            if self.read(name, [path]).isEmpty():
                self.remove(path)

    def rewrite(self, name: str, placed: DataFrame) -> list[tuple[str, int, bool]]:
        """Rewrite a table from its ``placed`` rows (with bucket and start): name, bucket and whether it stayed of each data file."""
        cells = placed.select(F.col(self.start).alias("s"), F.col(self.bucket).alias("b")).distinct()
        alone = lambda by, other: cells.groupBy(by).agg(F.count("*").alias("n"), F.max(other).alias(other)).where("n = 1").select("s", "b")
        # A start with one bucket that has one start: the same rows, in the same order.
        same = {r["s"]: r["b"] for r in alone("s", "b").intersect(alone("b", "s")).collect()}  # at most a row a bucket
        old = self.listed(name)
        self.write(name, placed.where(~F.col(self.bucket).isin([*same.values(), -1])), F.col(self.bucket))
        self.drop_empty(name)
        for path, number in old.items():
            if number not in same:
                self.remove(path)
        return [(path.rsplit("/", 1)[-1], same[number] if path in old else number, path in old) for path, number in self.listed(name).items()]

    def placed(self, name: str, rows: DataFrame, bucket: Column) -> DataFrame:
        """The rows with their bucket and the number of their starting file, written down."""
        path = f"{self.folder}-placed/{name}"
        rows.withColumn(self.bucket, bucket).withColumn(self.start, file_number(F.col(self.path))).drop(self.path).write.parquet(path)
        return self.spark.read.parquet(path)

    def forget(self) -> None:
        """Placed rows aren't needed once the files lie there."""
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}-placed"), True)


def _digests(pair: Pair, name: str, start: Column) -> DataFrame:
    """path, n_rows, ids_sha256, lineage_sha256 of the table's final files, from the files as they lie there."""
    rows = pair.read(name).select(F.col(pair.path).alias("path"), F.col(f"`{pair.key}`").alias("id"), start.alias("s"))
    known = rows.groupBy("path", "s").agg(F.count("*").alias("n"))
    line = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws(":", x["s"].cast("string"), x["n"].cast("string"))))
    files = known.groupBy("path").agg(F.sha2(line, 256).alias("lineage_sha256"), F.sum("n").alias("n_rows"))  # a file has as many starts as there are buckets, at most
    number = file_number(F.col("path"))
    streams = deal(rows.select("path", "id"), number, pair.keys).sortWithinPartitions("path", F.asc_nulls_first("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, out = None, None, []
        for batch in batches:
            paths = batch.column(0)
            at = 0
            while at < batch.num_rows:
                path = paths[at].as_py()
                upto = at + pc.sum(pc.equal(paths.slice(at), path)).as_py()  # sorted: a run
                if path != own:
                    if own is not None:
                        out.append((own, digest.hexdigest()))
                    own, digest = path, hashlib.sha256()
                else:
                    digest.update(b",")
                ids = batch.column(1).slice(at, upto - at).to_pylist()
                digest.update(",".join(["" if i is None else str(i) for i in ids]).encode())
                at = upto
        if own is not None:
            out.append((own, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["path", "ids_sha256"])

    return files.join(streams.mapInArrow(tidy(run), "path string, ids_sha256 string"), "path")


def cobucket(left: DataFrame, right: DataFrame, key: str, spread: str, names: tuple[str, str], folder: str | None = None, buckets: int = BUCKETS, salt: str = SALT) -> DataFrame:
    """Write ``left`` and ``right`` under ``folder`` (a new one in the shared folder if None) and rewrite them co-bucketed by ``key``.

    ``left`` starts in file b, or b - 1 where b mod 3 = 1; ``right`` by the crc32 of ``spread``. A row for each final file:
    table_name, path, columns, ids_sha256, lineage_sha256, bucket, n_rows, n_joined, rewritten.
    """
    spark = left.sparkSession
    pair = Pair(spark, folder or fresh_dir(spark, "cobucket"), left, right, key, names, buckets, salt)
    one, two = names
    home = F.coalesce(crc_bucket(F.col(f"`{key}`"), salt, buckets), F.lit(buckets + 1))
    merged = F.when(home % 3 == 1, home - 1).otherwise(home)
    scattered = F.coalesce(crc_bucket(F.col(f"`{spread}`"), "", buckets), F.lit(0))
    pair.write(one, left, merged)
    pair.write(two, right, scattered)
    for name in names:
        pair.drop_empty(name)
    there = unused("is_there", left, right)
    ids = pair.read(one).select(F.col(f"`{key}`")).where(F.col(f"`{key}`").isNotNull()).distinct().withColumn(there, F.lit(True))
    # The right rows' own join: of a hot key, Spark splits the rows.
    met = pair.read(two).join(ids, key, "left").select(*(F.col(f"`{c}`") for c in [*right.columns, pair.path, there]))
    bucket = F.when(F.col(f"`{key}`").isNull(), buckets + 1).when(F.col(there).isNull(), buckets).otherwise(home)
    # Both tables' rows are placed before any starting file goes.
    rows = {one: pair.placed(one, pair.read(one), home), two: pair.placed(two, met.withColumn(pair.bucket, bucket).drop(there), F.col(pair.bucket))}
    files = [(name, *f) for name in names for f in pair.rewrite(name, rows[name])]
    pair.forget()
    count = lambda name, n: pair.read(name).where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(F.count("*").alias(n))
    joined = count(one, "x").join(count(two, "y"), "id").groupBy(crc_bucket(F.col("id"), salt, buckets).alias("bucket")).agg(F.sum(F.col("x") * F.col("y")).alias("n_joined"))
    known = spark.createDataFrame(files, "table_name string, name string, bucket long, stayed boolean")  # a row a file
    digests = [_digests(pair, n, s).select("path", F.lit(",".join(pair.tables[n].columns)).alias("columns"), "ids_sha256", "lineage_sha256", "n_rows") for n, s in ((one, merged), (two, scattered)) if any(f[0] == n for f in files)]
    if not digests:
        return known.select("table_name", *(F.lit("").alias(c) for c in ("path", "columns", "ids_sha256", "lineage_sha256")), "bucket", *(F.lit(0).cast("long").alias(c) for c in ("n_rows", "n_joined")), (~F.col("stayed")).alias("rewritten"))
    both = digests[0] if len(digests) == 1 else digests[0].unionByName(digests[1])
    whole = both.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(known), "name").join(joined, "bucket", "left")
    whole = whole.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))  # as a URI without an authority is written in full
    return whole.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), (~F.col("stayed")).alias("rewritten"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cobucket(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), "sale_id", "item_id", ("sales", "sale_lines"))
