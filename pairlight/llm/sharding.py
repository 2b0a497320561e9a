"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form an indivisible group; a group goes to one shard.
Groups are sorted by size, largest first, and each enters the bin with the
tightest remaining capacity that still holds it, found in a balanced search
tree over the remaining capacities. The number of bins is least that way for a
fixed capacity (``pack``, or ``assign`` with ``capacity``); ``balance`` looks for the
least capacity that needs no more than the wanted number of bins, which makes the
shards' sizes near equal.

Every group is packed, at every scale. Groups of one size are alike to the
packing, so the driver sees a row for each distinct size, not for each group: as
sizes are distinct whole bytes, there are at most sqrt(2 * total bytes) of them,
245,000 for 30 GB at worst and some ten thousand in practice. The plan says how
many groups of a size each bin takes; within a size groups are ranked by digest
and dealt out by rank. Ranks and slots are numbered in stretches, so that neither
a common size nor a shard is one task's. Texts that more than a thousandth of
all rows share, a thousand at most, are broadcast; so no task holds a hot text's
rows. A group larger than a shard's share can't be split and takes a shard by
itself, the others then share the rest.

Null text: size 8, CRC 0, one group, apart from empty texts. Repeated rows,
doc_ids included, each get their slot. Very long texts: one row each, of which
only size and digest travel. Empty table: empty result. Extra columns are
carried along where ``carry`` names them, unless they bear an output's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.session import stored

SHARDS = 24
#: A text that more than one in so many rows share is hot.
HOT = 1000
#: Stretches of a shard whose slots are numbered apart, and groups of a size that are ranked together.
STRETCHES, RANKED = 32, 100_000


class Remaining:
    """A balanced tree (treap) of (remaining capacity, bin)."""

    __slots__ = ("root", "seed")

    def __init__(self) -> None:
        self.root, self.seed = None, 0x2545F491

    def _next(self) -> int:
        self.seed ^= (self.seed << 13) & 0xFFFFFFFF
        self.seed ^= self.seed >> 17
        self.seed ^= (self.seed << 5) & 0xFFFFFFFF
        return self.seed

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, capacity: int, bin_no: int) -> None:
        left, right = self._split(self.root, (capacity, bin_no))
        self.root = self._join(self._join(left, [(capacity, bin_no), self._next(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (capacity, bin) that holds ``size``."""
        best, node = None, self.root
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is None:
            return None
        left, rest = self._split(self.root, best)
        _, right = self._split(rest, (best[0], best[1] + 1))
        self.root = self._join(left, right)
        return best


def pack(sizes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit-decreasing of (size, how many groups): runs (size, first, end, bin) of groups of a size, and the number of bins.

    The bin that a group enters stays the tightest for the next one of its size as long as it holds it, so a run is
    one step. A group over the capacity opens a bin of its own.
    """
    bins, free, runs = 0, Remaining(), []
    for size, many in sorted(sizes, reverse=True):
        at = 0
        while at < many:
            found = free.take(size)
            if found is None:
                found = capacity, bins
                bins += 1
            left, where = found
            n = min(many - at, max(1, left // size))
            runs.append((size, at, at + n, where))
            at += n
            if left > n * size:
                free.add(left - n * size, where)
    return runs, bins


def balance(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, first, end, shard), by the least capacity at which best-fit-decreasing needs at most ``shards`` bins.

    Groups over an even share of what is left first take shards of their own.
    """
    rest, own = sorted(sizes), []
    total = sum(size * many for size, many in rest)
    while rest and shards - len(own) > 1 and rest[-1][0] * (shards - len(own)) > total:
        size, many = rest.pop()
        own.append((size, sum(x[0] == size for x in own), len(own)))
        total -= size
        if many > 1:
            rest.append((size, many - 1))
    first, wanted = len(own), shards - len(own)
    low = -(-total // wanted)
    high = max(2 * low, rest[-1][0] if rest else 1)
    found, bins = pack(rest, high)
    while bins > wanted:
        high *= 2
        found, bins = pack(rest, high)
    while low < high and high - low > total // (wanted * 100_000):
        mid = (low + high) // 2
        trial, bins = pack(rest, mid)
        if bins <= wanted:
            found, high = trial, mid
        else:
            low = mid + 1
    before = {size: sum(x[0] == size for x in own) for size, _, _ in own}
    return [(size, nth, nth + 1, shard) for size, nth, shard in own] + [(size, a + before.get(size, 0), b + before.get(size, 0), first + at) for size, a, b, at in found]


def _numbered(rows: DataFrame, within: str, stretch: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within ``within``: counted in stretches, each behind the rows of those before it."""
    cut = rows.withColumn("__stretch", stretch.cast("int"))
    counts = cut.groupBy(within, "__stretch").count()
    ahead = counts.select(within, "__stretch", (F.sum("count").over(W.partitionBy(within).orderBy("__stretch")) - F.col("count")).alias("__ahead"))
    at = F.row_number().over(W.partitionBy(within, "__stretch").orderBy(*order)) - 1
    return cut.withColumn("__at", at).join(ahead, [within, "__stretch"]).withColumn(name, (F.col("__ahead") + F.col("__at")).cast("long")).drop("__stretch", "__at", "__ahead")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, capacity: int | None = None, hot: int = HOT, stretches: int = STRETCHES, ranked: int = RANKED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``; with ``capacity`` as few shards of so many bytes as it takes."""
    spark: SparkSession = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))
    carry = tuple(c for c in carry if c not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    rows = docs.select(
        *(F.col(f"`{c}`") for c in carry),
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(text.isNull(), F.lit(b"null")).otherwise(F.unhex(F.sha2(raw, 256))).alias("g"),
    )
    rows = stored(rows, "sharding-rows")  # texts are read and digested once
    # Partial sums leave the scan, so that a hot group is a row a task.
    groups = stored(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "sharding-groups")
    sizes = [(int(r["bytes"]), int(r["count"])) for r in groups.groupBy("bytes").count().toLocalIterator()]
    plan = ([] if not sizes else balance(sizes, shards)) if capacity is None else pack(sizes, capacity)[0]
    runs = spark.createDataFrame(plan, "bytes long, first long, end long, shard int")
    many = dict(sizes)
    parted = {size for size, first, _, _ in plan if first}
    split = spark.createDataFrame([(size, -(-many[size] // ranked)) for size in parted], "bytes long, pieces int")
    # Sizes that one bin takes whole need no ranks.
    whole = groups.join(F.broadcast(runs.join(F.broadcast(split), "bytes", "left_anti")), "bytes").select("g", "shard", "copies")
    piece = F.pmod(F.xxhash64("g", F.lit(1)), F.col("pieces"))
    by_rank = _numbered(groups.join(F.broadcast(split), "bytes"), "bytes", piece, ["g"], "nth").join(F.broadcast(runs), "bytes").where("nth >= first and nth < end").select("g", "shard", "copies")
    placed = stored(whole.unionByName(by_rank), "sharding-placed")
    total = rows.count()
    known = F.broadcast(placed.where(F.col("copies") * hot > total).select("g", "shard"))  # fewer than ``hot`` rows
    others = rows.join(known.select("g"), "g", "left_anti").join(placed.where(F.col("copies") * hot <= total).select("g", "shard"), "g")
    dealt = others.unionByName(rows.join(known, "g").select(others.columns)).drop("g")
    slotted = _numbered(dealt, "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(stretches)), ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *carry)


def write_shards(docs: DataFrame, path: str, text_col: str = "text", rows_per_file: int = 100_000, **how) -> None:
    """Write the texts as one folder a shard; a file holds a run of slots in order."""
    dealt = assign(docs, text_col=text_col, carry=(text_col,), **how)
    dealt.repartition("shard", F.floor(F.col("slot") / rows_per_file)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
