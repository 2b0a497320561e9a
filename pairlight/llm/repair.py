"""Conversation structure repair: a forward Viterbi program over four grammar states.

A conversation is sound if its roles' initials read ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in
turn. The states are where that grammar may stand: at the start, behind a system turn, behind a user, behind an
assistant. Each carries the cheapest way to it as (cost, audit string), the edits' initials; the smaller pair wins, so
ties go to the audit that is least in ASCII. A row moves the states by keep, rerole or delete; then the layer is closed
by inserts, of which two lead from any state to any other it can reach.

Comparing audits layer by layer is right: two of equal cost over the same rows never begin one with the other, as every
insert costs something, so what follows can't turn their order.

Rows are dealt out by conversation, sorted, and pass through a task as a stream. A state also carries the running
SHA-256 of what it has kept, so no text is held; audits share what they begin with, which is set aside as it grows. A
conversation is one stream by nature, as its digest is one sequence; beside 16 bytes for each distinct turn (to know
repeats) nothing is held of it.

Null roles and texts are one space. Null turns come first. Rows that share a turn are taken by role, then text, in
UTF-8 bytes. Rows without a conv_id are one conversation. Repeated rows are duplicates by the rule. Empty tables: no
rows. Extra columns are ignored, whatever their names. Very long texts are read whole. An empty role has no initial: such a row
may be kept anywhere.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.llm.text import slices, tidy
from pairlight.session import table

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: White space, ends of sentences, initials that may stand next to each other.
SPACE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", frozenset({"su", "ua", "au"})
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: From a state to the states that a turn with an initial leads to.
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Rows after which audits are looked at for a common beginning.
SETTLE = 256

FIELDS = (("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType()), ("repaired_sha256", T.StringType()))


class Way:
    """The cheapest way to a state: cost, audit since the last settling, digest of what it keeps."""

    __slots__ = ("audit", "cost", "digest", "first")

    def __init__(self, cost: int, audit: str, digest, first: bool) -> None:
        self.cost, self.audit, self.digest, self.first = cost, audit, digest, first

    def kept(self, role: str, text: str) -> Way:
        digest = self.digest.copy()
        digest.update(("" if self.first else "\n").encode() + role.encode() + b":" + text.encode())
        return Way(self.cost, self.audit, digest, False)


def _better(a: tuple[int, str], b: Way | tuple | None) -> bool:
    return b is None or a < ((b.cost, b.audit) if isinstance(b, Way) else b[:2])


class Repair:
    """One conversation, row by row; ``done`` gives its result."""

    def __init__(self) -> None:
        self.ways: list[Way | None] = self._closed([Way(0, "", hashlib.sha256(), True), None, None, None])
        self.settled: list[str] = []
        self.seen: set[bytes] = set()
        self.turns: tuple[int, int, int] | None = None  # least, most, how many; turns come in order
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.before: str | None = None

    @staticmethod
    def _closed(ways: list[Way | None]) -> list[Way | None]:
        """With at most two inserts more."""
        for _ in range(2):
            for state in (START, SYSTEM, USER, ASSISTANT):
                way = ways[state]
                for to in set(AFTER[state].values()) - {SYSTEM} if way else ():
                    if _better((way.cost + INSERT, way.audit + "I"), ways[to]):
                        new = way.kept(ROLES[to], "")
                        new.cost, new.audit = way.cost + INSERT, way.audit + "I"
                        ways[to] = new
        return ways

    def fault(self, role: str, text: str) -> str | None:
        """The first fault of the next row."""
        bare = text.strip(SPACE)
        if not bare:
            self.blank += 1
            return "blank"
        key = hashlib.blake2b(role.encode() + b"\0" + len(role).to_bytes(8, "big") + text.encode(), digest_size=16).digest()
        if key in self.seen:
            self.duplicate += 1
            return "duplicate"
        self.seen.add(key)
        if bare[-1] not in ENDS:
            self.truncated += 1
            return "truncated"
        return None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            least, most, many = self.turns or (turn, turn, 1)
            self.turns = least, turn, many + (turn != most)
        initial = role[:1]
        if self.rows:
            self.illegal += (self.before + initial) not in LEGAL
        self.rows += 1
        self.before = initial
        fault = self.fault(role, text)
        late = TRUNCATED if fault == "truncated" else 0
        best: list[tuple | None] = [None] * 4  # cost, audit, way, role or None for a deleted row
        for state, way in enumerate(self.ways):
            if way is None:
                continue
            moves = [(DELETE, "D", state, None)]
            if fault not in ("blank", "duplicate"):
                if initial in AFTER[state] or not initial:
                    moves.append((late, "K", AFTER[state][initial] if initial else state, role))
                moves += [(REROLE + late, "R", to, ROLES[to]) for to in AFTER[state].values() if to in ROLES]
            for cost, edit, to, name in moves:
                if _better((way.cost + cost, way.audit + edit), best[to]):
                    best[to] = (way.cost + cost, way.audit + edit, way, name)
        ways: list[Way | None] = [None] * 4
        for to, found in enumerate(best):
            if found:
                cost, audit, way, name = found
                new = way.kept(name, text) if name is not None else Way(cost, audit, way.digest, way.first)
                new.cost, new.audit = cost, audit
                ways[to] = new
        self.ways = self._closed(ways)
        # Behind an assistant all is possible that is at the start or behind a system turn, but for a system turn, and that can be deleted.
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if self.ways[state] and self.ways[ASSISTANT] and self.ways[state].cost > self.ways[ASSISTANT].cost + more:
                self.ways[state] = None
        if self.rows % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        common = os.path.commonprefix([w.audit for w in self.ways if w])
        self.settled.append(common)
        for way in self.ways:
            if way:
                way.audit = way.audit[len(common) :]

    def done(self) -> tuple[int, int, int, int, int, int, str, str]:
        way = min((w for w in (self.ways[START], self.ways[ASSISTANT]) if w), key=lambda w: (w.cost, w.audit))
        least, most, many = self.turns or (0, 0, 1)
        return most - least + 1 - many, self.blank, self.duplicate, self.truncated, self.illegal, way.cost, "".join([*self.settled, way.audit]), way.digest.hexdigest()


def repair(turns: DataFrame, copies: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``copies`` says how often a row is taken (1 if None); a conversation all of whose rows are taken 0 times has a row
    of zeros, an empty audit and the digest of nothing.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Repair | None = None
        conv, out = None, []

        def flushed() -> pa.RecordBatch:
            names = [f for f, _ in FIELDS]
            batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), *(pa.array([r[i] for _, r in out]) for i in range(len(names)))], names=["conv_id", *names])
            out.clear()
            return batch

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, "text", 8 << 20, 2000):
                for at, turn, role, body, many in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if own is None or at != conv:
                        if own is not None:
                            out.append((conv, own.done()))
                        own, conv = Repair(), at
                    for _ in range(many):
                        own.add(turn, role, body)
                if len(out) >= 2000:
                    yield flushed()
        if own is not None:
            out.append((conv, own.done()))
        if out:
            yield flushed()

    return ordered.mapInArrow(tidy(run), T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(n, t) for n, t in FIELDS)]))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the contract's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    act = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id", "turn", F.when(act == 4, "user").otherwise(role).alias("role"),
        F.when(act == 1, "").when(act == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(act == 0, 0).when(act == 3, 2).otherwise(1).alias("copies"),
    )


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of a conversation's rows after the edits of an audit."""
    out, at, turn = [], START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turn)
        if edit == "D":
            continue
        at = AFTER[at].get(role[:1], at) if edit == "K" else ASSISTANT if at == USER else USER
        out.append((role if edit == "K" else ROLES[at], text))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair(hurt, F.col("copies"))


_WHITE = r"[^\x20\x09-\x0D]"

#: The damage and the same program as a recursive query: a layer a row, the least (cost, audit) a state.
ORACLE = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
acted AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(k, lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS act FROM keyed, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE act WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM acted),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px FROM ordered),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_WHITE}') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND px || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
step(a, x, b) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
ins(a, b, c, e, put) AS (SELECT DISTINCT a, a, 0, '', CAST([] AS VARCHAR[]) FROM (SELECT a FROM step UNION SELECT b FROM step) UNION ALL VALUES ('0', 'u', 2, 'I', ['user:']), ('0', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 'u', 2, 'I', ['user:']), ('s', 'a', 4, 'II', ['user:', 'assistant:']), ('u', 'a', 2, 'I', ['assistant:']), ('a', 'u', 2, 'I', ['user:'])),
dp(conv_id, i, st, cost, audit, kept) AS (
  SELECT conv_id, CAST(0 AS BIGINT), b, c, e, put FROM counts, ins WHERE a = '0'
  UNION ALL
  SELECT conv_id, i, st, cost, audit, kept FROM (
    SELECT dp.conv_id, j.i, ins.b AS st, dp.cost + m.c + CASE WHEN j.fault = 'truncated' AND m.e <> 'D' THEN 1 ELSE 0 END + ins.c AS cost, dp.audit || m.e || ins.e AS audit,
      list_concat(dp.kept, CASE m.e WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE m.b WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] END, ins.put) AS kept
    FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.i = dp.i + 1
    JOIN (SELECT a, x, b, 'K' AS e, 0 AS c FROM step UNION ALL SELECT DISTINCT a, NULL, b, 'R', 2 FROM step WHERE b <> 's' UNION ALL SELECT DISTINCT a, NULL, a, 'D', 3 FROM ins UNION ALL SELECT DISTINCT a, '', a, 'K', 0 FROM ins) m
      ON m.a = dp.st AND (m.e = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (m.e <> 'K' OR m.x = j.x)
    JOIN ins ON ins.a = m.b) q
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, st ORDER BY cost, audit) = 1),
best AS (SELECT dp.* FROM dp JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.i WHERE st IN ('0', 'a') QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost, audit) = 1)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id"""
