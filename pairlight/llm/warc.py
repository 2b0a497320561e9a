"""WARC archives with revisits, and the external merge of their capture index.

``write`` puts one record a page into gzipped WARC 1.1 segments in the shared
folder. Each segment is a run: its index entries are sorted by URL key (host
reversed), timestamp and page. ``merge`` joins the runs into one globally ordered
capture history: key ranges of about ``RANGE`` entries are dealt to tasks, and
each merges its part of all runs with a loser tree, lazily, from columns that take
some 200 bytes an entry. ``read`` walks the merged index, reads every record back
from its archive and digests what it finds; a revisit's payload is that of the
record it refers to.

Of pages with equal payloads of at least 100 bytes, the one with the smallest
page_id is a response, the others revisit it and carry no payload; smaller
payloads are always responses. Equality is by SHA-256. Pages travel by page_id and
digest, so copies of one payload are dealt out like any rows, and a revisit's html
isn't sent. Payloads that more than a thousandth of all rows share, a thousand at
most, are told by broadcast.

A lost task writes its segments anew under new names; the index only names
segments of tasks that ended, so what a lost task left is never read.

Null html: an empty payload. Null url: no target, sorts first. Null page_id:
later than all others, written as ``null``. Rows that share page_id and payload
are all responses. A very long payload is one record and is held whole. Empty
table: no archives, empty result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.session import fresh_dir, stored

LEAST = 100
#: A segment ends behind the record that takes it over so many bytes.
SEGMENT = 64 << 20
#: Entries that one task merges, about; a payload shared by one in HOT rows is hot.
RANGE, HOT = 100_000, 1000
LAST = 2**63 - 1
EPOCH = datetime(2026, 1, 1, tzinfo=UTC)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "run string, pos long, url_key string, ts string, pid long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host parts from the top level down, then port, path and query: ``org,example,www)/path?query``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _name(pid: int | None) -> str:
    return "<urn:page:null>" if pid is None or pid == LAST else f"<urn:page:{pid}>"


def _number(name: str) -> int | None:
    tail = name.rstrip(">").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def record(pid: int, url: str | None, ts: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a WARC record; ``payload`` is empty for a revisit, ``size`` is its length all the same."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(pid)}", f"WARC-Date: {ts}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(folder)
        out, name, offset, entries = None, "", 0, []

        def close() -> pa.RecordBatch:
            out.close()
            entries.sort()
            key, ts, pid, at, length = zip(*entries, strict=True)
            n = len(entries)
            columns = [pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array(key), pa.array(ts), pa.array(pid, pa.int64()), pa.array([name] * n), pa.array(at, pa.int64()), pa.array(length, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _INDEX.split(", ")])

        for batch in batches:
            for pid, url, html, size, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("pid", "url", "html", "n", "digest", "refers_to")), strict=True):
                if out is None:
                    name, offset, entries = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                ts = (EPOCH + timedelta(seconds=(pid % 31_536_000))).strftime("%Y-%m-%dT%H:%M:%SZ")
                member = record(pid, url, ts, html or b"", size, digest, refers)
                out.write(member)
                entries.append((url_key(url), ts, pid, offset, len(member)))
                offset += len(member)
                if offset >= segment:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, segment: int = SEGMENT) -> DataFrame:
    """Write the archives under ``folder``; returns the index of all runs, stored."""
    system, base = _store(folder)
    system.create_dir(base, recursive=True)
    raw = F.coalesce(F.col(f"`{html_col}`").cast("string").cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("pid"), F.col(f"`{url_col}`").cast("string").alias("url"), raw.alias("html"), F.sha2(raw, 256).alias("digest"))
    sized = stored(rows.select("pid", "digest", F.octet_length("html").cast("long").alias("n")), "warc-sizes")
    # A hot payload leaves each task as one row.
    first = sized.where(F.col("n") >= least).groupBy("digest").agg(F.min("pid").alias("first"), F.max("pid").alias("last"), F.count("*").alias("c")).where("first < last").select("digest", "first", "c")
    revisits = joined(sized, first, ["digest"], "c", sized.count()).where("first < pid").select("pid", "digest", F.col("first").alias("refers_to")).distinct()
    told = rows.join(revisits, ["pid", "digest"], "left").select("pid", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("n"), "digest", "refers_to")
    return stored(told.mapInArrow(_write(folder, segment), _INDEX), "warc-runs")


def joined(rows: DataFrame, told: DataFrame, key: list[str], count: str, total: int, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``told`` on ``key``; keys with more than one in ``hot`` of ``total`` rows, ``hot`` at most, are broadcast and not shuffled."""
    told = stored(told, "warc-told")
    many = F.broadcast(told.where(F.col(count) * hot > total))
    few = rows.join(many.select(*key), key, "left_anti").join(told.where(F.col(count) * hot <= total), key)
    return few.unionByName(rows.join(many, key))


class LoserTree:
    """K sorted runs as one sorted stream; each step replays one path of log2(k) matches."""

    def __init__(self, runs: list[Iterable]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._build(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _build(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.k) // 2
            while node > 0:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


_HISTORY = "url_key string, ts string, pid long, file string, offset long, length long, place long"


def _lazily(run: pa.Table, step: int = 1000) -> Iterator[tuple]:
    """A run's entries (key, ts, pid, file, offset, length), made a few at a time."""
    for batch in run.to_batches(max_chunksize=step):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (run, pos): merge the runs of this key range."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).select(["run", "url_key", "ts", "pid", "file", "offset", "length"])
    run = table.column("run").combine_chunks().dictionary_encode()
    run = run.combine_chunks() if isinstance(run, pa.ChunkedArray) else run
    codes = run.indices.to_numpy()
    starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    entries = table.drop_columns(["run"])
    merged = iter(LoserTree([_lazily(entries.slice(a, b - a)) for a, b in zip(starts, starts[1:], strict=False)]))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    at = 0
    while part := list(islice(merged, 10_000)):
        columns = [*zip(*part, strict=True), range(at, at + len(part))]
        at += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _HISTORY.split(", ")])


def merge(index: DataFrame, entries: int = RANGE) -> DataFrame:
    """The capture history: url_key, ts, pid, file, offset, length; partitions follow each other in key order, ``place`` orders a partition."""
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // entries))
    return index.repartitionByRange(parts, "url_key", "ts", "pid").sortWithinPartitions("run", "pos").mapInArrow(_merge, _HISTORY)


_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(folder)
        name, stream = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, system.open_input_file(f"{base}/{file}")
                stream.seek(offset)
                fields, payload = parse(stream.read(length))
                refers = fields.get("WARC-Refers-To")
                digest = hashlib.sha256(payload).hexdigest() if refers is None else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                out.append((_number(fields["WARC-Record-ID"]), len(payload) if refers is None else None, digest, fields["WARC-Type"], None if refers is None else _number(refers)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if stream is not None:
            stream.close()

    return run


def read(history: DataFrame, folder: str) -> DataFrame:
    """Every capture of a history, read from the archives file by file; revisits take size and digest from the payload they refer to."""
    by_file = history.repartition(F.col("file"), F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")
    found = stored(by_file.mapInArrow(_read(folder), _FOUND), "warc-found")
    revisits = found.where("record_type = 'revisit'").select("page_id", F.col("refers_to").alias("ref"), F.col("payload_digest").alias("digest"), "record_type")
    counts = revisits.groupBy("ref", "digest").agg(F.count("*").alias("c"))
    responses = found.where("record_type = 'response'").select(F.col("page_id").alias("ref"), F.col("payload_digest").alias("digest"), "payload_bytes").distinct()
    resolved = joined(revisits, counts.join(responses, ["ref", "digest"], "left"), ["ref", "digest"], "c", found.count())
    broken = F.raise_error(F.concat(F.lit("a revisit refers to a payload that no record holds: "), F.col("ref").cast("string"))).cast("long")
    size = F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(broken)
    told = resolved.select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("ref").alias("refers_to"))
    return found.where("record_type = 'response'").unionByName(told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = fresh_dir(spark, "warc")
    return read(merge(write(pages, folder)), folder)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
