"""Near-duplicate documents by b-bit MinHash.

Documents are linked if of * |A and B| >= share * |A or B| (85 of 100 unless
asked otherwise) over their sets of distinct 5-word shingles (A-Z lower-cased,
words ``[^\\x20\\x09-\\x0D]+``). A connected component is a group; its smallest
doc_id stays.

1. A scan makes each document's set, a digest of it, minima in bands of 5 and the
   low 4 bits of each minimum, packed into longs.
2. Equal sets are one representative: exact copies never meet in pairs.
3. Representatives that share a band are candidates. There are as many bands as
   keep the chance that two at the threshold miss all of them, (1 - share**5)**bands,
   below 1e-6: 24 at 0.85, 35 at 0.8.
4. A bucket is not expanded into pairs. Its pivot, the smallest document, is
   compared with the other members. Such a pair is estimated first: equal packed
   bits are counted and corrected for chance; only pairs five standard errors
   below the threshold are let go, all others are confirmed on the full sets.
5. Documents that then still lie outside their bucket's main component ask all
   others of the bucket, in blocks of bounded size, again on the full sets, so
   that no link that could join two components is left out.

Null or empty texts and texts without words have an empty set and are linked to
nothing. One to four words: the whole sequence is the one shingle. Rows that
share a doc_id are one document, linked with what any of its rows is linked
with; ``n_shingles`` is a row's own. A row without a doc_id is a document by
itself: it links others like any text, its component_id is null if nothing it
reaches has an id, and it is kept only then. ``once`` adds ``stays``, true for
exactly one row of each component, be its rows repeated or without ids. Very
long texts: a block holds a bounded number of shingles, or one document. Empty
table: empty result. Extra columns pass through ``near_duplicates`` and change
no result; output columns replace their likes.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.llm.shingles import Sketcher, shingle_sets
from pairlight.llm.text import mix, slices, tidy
from pairlight.session import stored

SHARE, OF = 85, 100
ROWS, BITS = 5, 4
#: Chance at most that two documents at the threshold share no band.
MISS = 1e-6
CHANCE = 2.0**-BITS
#: Pivots in each round.
PIVOTS = (1,)
#: Shingles of a bucket's documents in one block, and of those that ask it.
BLOCK = 1_000_000
_SKETCH = "did long, th long, n long, d1 long, d2 long, sig array<long>, bands array<long>"
#: What tells rows apart: doc_id, whether it is null, and the text's hash.
_ROW = ["did", "none", "th"]


def bands_for(share: float) -> int:
    """The least number of bands that keeps the chance of a miss at ``share`` below ``MISS``."""
    return 1 if share >= 1 else math.floor(math.log(MISS) / math.log(1 - share**ROWS)) + 1


def longs(bands: int) -> int:
    return -(-bands * ROWS * BITS // 64)


def least_estimate(share: float, n: int) -> float:
    """Five standard errors below ``share``."""
    p = share + (1 - share) * CHANCE
    return share - 5 * (p * (1 - p) / n) ** 0.5 / (1 - CHANCE)


def _sketch(batches: Iterator[pa.RecordBatch], n_bands: int) -> Iterator[pa.RecordBatch]:
    sketcher = Sketcher(n_bands, ROWS, BITS)
    for whole in batches:
        for batch in slices(whole, limit=4 << 20):
            values, first = shingle_sets(batch.column("text"))
            n = np.diff(first)
            own = np.flatnonzero(n)
            d1, d2 = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
            sig = np.zeros((len(n), longs(n_bands) * 8), dtype=np.uint8)
            bands = np.zeros((len(n), n_bands), dtype=np.uint64)
            if len(own):
                starts = first[:-1][own]
                d1[own] = np.add.reduceat(mix(values), starts)
                d2[own] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                minima = sketcher.minima(values, first)
                packed = sketcher.packed(minima)
                sig[own, : packed.shape[1]] = packed
                bands[own] = sketcher.keys(minima)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("th"), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(np.ascontiguousarray(sig).view(np.uint64)), lists(bands)],
                names=["did", "th", "n", "d1", "d2", "sig", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, limit=4 << 20):
            values, first = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))], names=["rep", "s"])


def _answer(batches: Iterator[pa.RecordBatch], share: int, of: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, answers before askers: an inverted index of the answers' shingles counts what each asker shares with each."""
    now, held = None, []

    def settle() -> pa.RecordBatch:
        known, asks = [h for h in held if not h[0]], [h for h in held if h[0]]
        a, b = [], []
        if known and asks:
            reps, labels = np.array([h[1] for h in known]), np.array([h[2] for h in known])
            sizes = np.array([len(h[3]) for h in known])
            values, owner = np.concatenate([h[3] for h in known]), np.repeat(np.arange(len(known)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for _, rep, label, own in asks:
                lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                shared = np.bincount(owner[at], minlength=len(known))
                linked = np.flatnonzero((of * shared >= share * (sizes + len(own) - shared)) & (labels != label))
                # One link to each component is enough to join it.
                linked = linked[np.unique(labels[linked], return_index=True)[1]]
                a += [rep] * len(linked)
                b += reps[linked].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            keys = zip(*(part.column(c).to_pylist() for c in ("key", "i", "j")), strict=True)
            sets = part.column("s")
            values, offsets = sets.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
            for n, (key, odd, rep, label) in enumerate(zip(keys, *(part.column(c).to_pylist() for c in ("odd", "rep", "label")), strict=True)):
                if key != now:
                    if held:
                        yield settle()
                    now, held = key, []
                held.append((odd, rep, label, values[offsets[n] : offsets[n + 1]].copy()))
    if held:
        yield settle()


def estimate(a, b, bands: int):
    """Collision-corrected similarity of two packed signatures, as a Spark expression: a bit count over the longs."""

    def unlike(x, y):
        d = x.bitwiseXOR(y)
        for by in (1, 2):  # gather the bits of a four-bit group in its lowest
            d = d.bitwiseOR(F.shiftrightunsigned(d, by))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    total = sum((unlike(F.get(a, i), F.get(b, i)) for i in range(1, longs(bands))), unlike(F.get(a, 0), F.get(b, 0)))
    return ((1 - total / F.lit(float(bands * ROWS))) - CHANCE) / (1 - CHANCE)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; from (a, b) edges, by alternating large and small stars."""
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u > v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Links:
    """Components of representatives, grown round by round."""

    def __init__(self, reps: DataFrame, buckets: DataFrame, sets: DataFrame, same: DataFrame, share: int, of: int) -> None:
        self.reps, self.buckets, self.sets, self.share, self.of = reps, buckets, sets, share, of
        self.bands = bands_for(share / of)
        nodes = buckets.select("rep").unionByName(same.select(F.col("a").alias("rep"))).unionByName(same.select(F.col("b").alias("rep")))
        self.labels = nodes.distinct().withColumn("label", F.col("rep"))

    def _labelled(self) -> DataFrame:
        return self.buckets.join(self.labels, "rep")

    def pivots(self, n: int, seed: int) -> DataFrame:
        """Pairs of each bucket's pivots and its members of other components."""
        rows = self._labelled()
        order = [F.col("rep") if seed + j == 0 else F.xxhash64("rep", F.lit(seed + j)) for j in range(n)]
        mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *(F.min_by(F.struct("rep", "label"), o).alias(f"p{j}") for j, o in enumerate(order))).where("lo < hi")
        pairs = rows.join(mixed, "key").select("rep", "label", F.explode(F.array(*(f"p{j}" for j in range(n)))).alias("p")).where("p.label <> label")
        return pairs.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()

    def rest(self, block: int = BLOCK) -> DataFrame:
        """Links between a bucket's documents outside its most common component and those of its other components.

        The outsiders ask, all the bucket's documents answer, in blocks of bounded size; only links leave a block.
        Buckets of two are settled by their pivot, and equal buckets of several bands are one.
        """
        rows = self._labelled()
        counts = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("x"))
        most = F.struct("c", "label")
        mixed = counts.groupBy("key").agg(F.max_by("label", most).alias("main"), F.sum("c").alias("n"), F.sum("w").alias("w"), F.max_by("w", most).alias("most"), F.count("*").alias("parts"), F.sum("x").alias("x")).where("parts > 1 and n > 2")
        once = mixed.groupBy("n", "x").agg(*(F.min(F.struct("key", "main", "w", "most")).getField(c).alias(c) for c in ("key", "main", "w", "most")))
        around, asking = F.ceil(F.col("w") / block).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("most")) / block)).cast("int")
        open_rows = rows.join(once.select("key", "main", around.alias("nb"), asking.alias("ob")), "key")
        own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
        asks = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("ob")).cast("int")
        answers = open_rows.select("key", "rep", "label", F.lit(False).alias("odd"), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("j"))
        askers = open_rows.where("label <> main").select("key", "rep", "label", F.lit(True).alias("odd"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), asks.alias("j"))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share, of = self.share, self.of
        blocks = answers.unionByName(askers).join(self.sets, "rep").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "odd")
        return blocks.select("key", "i", "j", "odd", "rep", "label", "s").mapInArrow(tidy(lambda batches: _answer(batches, share, of)), "a long, b long")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the estimate's limit and then the threshold, on the full sets."""
        sig = self.reps.select("rep", "sig")
        near = (
            pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
            .where(estimate(F.col("sa"), F.col("sb"), self.bands) >= least_estimate(self.share / self.of, self.bands * ROWS))
            .select("a", "b")
        )
        near = stored(near.distinct(), "pairs")
        full = near.join(self.sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(self.sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return full.withColumn("both", both).where(self.of * F.col("both") >= self.share * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")

    def join_up(self, found: DataFrame) -> None:
        linked = stored(found.distinct(), "links")
        label = self.labels
        across = linked.join(label.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b")
        roots = components(across.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        self.labels = stored(label.join(roots, label["label"] == roots["node"], "left").select("rep", F.coalesce("root", "label").alias("label")), "labels")
        release(linked.sparkSession)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, of: int = OF, once: bool = False) -> DataFrame:
    """``docs`` with n_shingles, component_id and kept; with ``once`` also stays, which picks one row of each component."""
    text = F.col(f"`{text_col}`").cast("string")
    keyed = lambda d, *more: d.select(F.col(f"`{id_col}`").cast("long").alias("did"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), *more)
    base = keyed(docs, text.alias("text"))
    bands = bands_for(share / of)
    sketch = stored(base.mapInArrow(tidy(lambda batches: _sketch(batches, bands)), _SKETCH), "sketch")
    least = F.min(F.struct(F.col("did").isNull().alias("none"), "did", "th"))
    full = sketch.where("n > 0").groupBy("d1", "d2", "n").agg(least.alias("m"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # A set goes by its smallest doc_id; one that has none, by its digest.
    reps = stored(full.select("d1", "d2", "n", F.coalesce("m.did", "d1").alias("rep"), F.col("m.did").alias("least"), F.col("m.th").alias("th"), "sig", "bands"), "reps")
    spread = reps.select("rep", "n", F.explode("bands").alias("key"))
    crowded = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    buckets = stored(spread.join(crowded, "key").distinct(), "buckets")
    # Only documents that share a band with another need their sets.
    wanted = reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "least", F.col("th").alias("own"))
    sets = stored(base.join(wanted, F.col("did").eqNullSafe(F.col("least")) & (F.col("th") == F.col("own"))).select("rep", "text").mapInArrow(tidy(_sets), "rep long, s array<long>"), "sets")
    release(docs.sparkSession)
    # Rows that share a doc_id but not their sets are one document, which joins their components.
    rows = sketch.select("did", "th", "n", "d1", "d2")
    several = rows.where("did is not null").groupBy("did").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("did")
    same = stored(rows.join(several, "did").join(reps.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left").select(F.col("did").alias("a"), F.coalesce("rep", "did").alias("b")).distinct(), "same")
    links = Links(reps, buckets, sets, same, share, of)
    seed = 0
    for n in PIVOTS:
        found = links.confirm(links.pivots(n, seed))
        links.join_up(found if seed else found.unionByName(same))
        seed += n
    links.join_up(links.rest())
    return _attach(docs, keyed, rows, reps, links.labels, same, id_col, once)


def _attach(docs: DataFrame, keyed, rows: DataFrame, reps: DataFrame, labels: DataFrame, same: DataFrame, id_col: str, once: bool) -> DataFrame:
    """One result for each row, found by its doc_id and text alone."""
    in_all = reps.select("d1", "d2", "n", "rep", "least", "th").join(labels, "rep", "left").withColumn("root", F.coalesce("label", "rep"))
    named = in_all.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "th")).alias("m")).select("root", F.col("m.least").alias("component_id"), F.col("m.th").alias("first"))
    told = in_all.join(named, "root").select("d1", "d2", "n", "component_id", "first")
    worded = rows.where("n > 0").join(told, ["d1", "d2", "n"]).select("did", "th", "n", "component_id", "first")
    # A text without words has no set; it goes with other rows of its doc_id.
    hubs = same.select(F.col("a").alias("rep")).distinct().join(labels, "rep").join(named, F.col("label") == F.col("root")).select(F.col("rep").alias("did"), "component_id", "first")
    blank = rows.where("n = 0").join(hubs, "did", "left").select("did", "th", "n", F.coalesce("component_id", "did").alias("component_id"), F.coalesce("first", "th").alias("first"))
    by_row = worded.unionByName(blank)
    own = F.coalesce(F.col("did") == F.col("component_id"), F.col("did").isNull() & F.col("component_id").isNull()).alias("kept")
    made = ["n_shingles", "component_id", "kept"]
    if not once and len(docs.columns) <= 2:  # nothing to carry: the sketch has a row for each
        return by_row.select(F.col("did").alias(id_col), F.col("n").alias("n_shingles"), "component_id", own)
    known = by_row.withColumn("none", F.col("did").isNull()).withColumn("did", F.coalesce("did", F.lit(0))).groupBy(*_ROW).agg(*(F.min(c).alias(f"__{c}") for c in ("n", "component_id", "first")))
    kept = [c for c in docs.columns if c not in (*made, "stays")]
    named_rows = keyed(docs, *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept))).withColumn("none", F.col("did").isNull()).withColumn("did", F.coalesce("did", F.lit(0)))
    both = named_rows.join(known, _ROW).withColumns({"component_id": F.col("__component_id"), "did": F.when(~F.col("none"), F.col("did"))} if not once else {"component_id": F.col("__component_id")})
    out = [F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)]
    if not once:
        return both.select(*out, F.col("__n").alias("n_shingles"), "component_id", own)
    # The join leaves a row's repeats side by side.
    nth = F.row_number().over(W.partitionBy(*_ROW).orderBy("th"))
    own = F.when(F.col("none"), F.col("component_id").isNull()).otherwise(F.col("did") == F.col("component_id"))
    stays = own & (F.col("th") == F.col("__first")) & ((F.col("nth") == 1) | (F.col("none") & (F.col("__n") == 0)))
    return both.withColumn("nth", nth).select(*out, F.col("__n").alias("n_shingles"), "component_id", own.alias("kept"), stays.alias("stays"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p, q FROM x JOIN c cp ON cp.doc_id = p JOIN c cq ON cq.doc_id = q WHERE 100 * shared >= 85 * (cp.n + cq.n - shared)),
both_ways AS MATERIALIZED (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, q FROM r JOIN both_ways ON r.b = p)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, w.doc_id = m AS kept
FROM w LEFT JOIN c USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) z ON z.a = w.doc_id
"""
