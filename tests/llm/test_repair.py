"""Conversation repair against all edit sequences of small conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

from pairlight.llm import repair
from pairlight.llm.repair import Repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute(rows: list[tuple[str, str]], inserts: int = 3) -> tuple[int, str, list[str]]:
    """Least (cost, audit) by trying every edit of every row with up to ``inserts`` inserts in each gap."""
    seen, faults = set(), []
    for row in rows:
        bare = row[1].strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if row in seen else "" if bare[-1] in ".!?" else "truncated")
        if bare:
            seen.add(row)
    gaps = [p for n in range(inserts) for p in itertools.product("ua", repeat=n)]
    best = None

    def go(i, cost, audit, kept):
        nonlocal best
        if best and cost > best[0]:
            return
        for gap in gaps:
            c, a, k = cost + 2 * len(gap), audit + "I" * len(gap), kept + [(g, {"u": "user:", "a": "assistant:"}[g]) for g in gap]
            if not _open("".join(x for x, _ in k)):
                continue
            if i == len(rows):
                if GRAMMAR.fullmatch("".join(x for x, _ in k)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, [t for _, t in k])
                continue
            role, text = rows[i]
            go(i + 1, c + 3, a + "D", k)
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                go(i + 1, c + late, a + "K", [*k, (role[:1], f"{role}:{text}")])
                for name in ("user", "assistant"):
                    go(i + 1, c + 2 + late, a + "R", [*k, (name[0], f"{name}:{text}")])

    go(0, 0, "", [])
    return best


def _open(initials: str) -> bool:
    """Whether something sound may begin so."""
    return bool(re.fullmatch(r"s?(ua)*u?", initials))


def one(rows, turns=None):
    own = Repair()
    for i, (role, text) in enumerate(rows):
        own.add(i if turns is None else turns[i], role, text)
    return own.done()


def test_against_all_edits():
    draw = random.Random(5)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", " ", ""], ["Yes.", "No!", "cut", " ", "", "Why? ", "a.\n", "b\x0b"]
    for _ in range(250):
        rows = [(draw.choice(roles), draw.choice(texts)) for _ in range(draw.randrange(6))]
        cost, audit, kept = brute(rows)
        got = one(rows)
        assert got[5:7] == (cost, audit), rows
        assert got[7] == hashlib.sha256("\n".join(kept).encode()).hexdigest(), rows
        assert ["%s:%s" % x for x in repair.repaired(rows, audit)] == kept


def test_counts_and_gaps():
    rows = [("user", "Hi."), ("user", "Hi."), ("assistant", "so"), ("assistant", " ")]
    assert one(rows, [1, 1, 4, 7])[:5] == (4, 1, 1, 1, 2)
    assert one([("user", "A."), ("assistant", "B.")], [None, 3])[0] == 0
    assert one([]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversations_settle():
    """A long conversation's audit is that of its halves, and what the states carry stays short."""
    own = Repair()
    for i in range(20_000):
        own.add(i, "user" if i % 2 == 0 else "assistant", f"{i}." if i % 7 else f"{i}")
        assert i < 600 or max(len(w.audit) for w in own.ways if w) < 600
    got = own.done()
    assert got[6] == "K" * 20_000 and got[5] == got[3] == len(range(0, 20_000, 7))


def test_frames(spark):
    rows = [(1, 0, "user", "Q?"), (1, 1, "assistant", "A."), (2, None, None, None), (2, 5, "user", "x"), (None, 0, "user", "Q?"), (3, 0, "user", "gone."), (1, 1, "assistant", "A.")]
    hurt = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS copies_", "if(conv_id = 3, 0, 1) AS copies", "1 AS audit")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(hurt, hurt.copies).collect()}
    assert got[1] == one([("user", "Q?"), ("assistant", "A."), ("assistant", "A.")], [0, 1, 1])
    assert got[2] == one([(" ", " "), ("user", "x")], [None, 5]) and got[None] == one([("user", "Q?")], [0]) and got[3] == one([])
    assert repair.repair(hurt.limit(0)).count() == 0


def test_damage(spark):
    import zlib

    turns = spark.range(200).selectExpr("id % 40 AS conv_id", "id AS turn", "'assistant' AS role", "'One. Two? Three!' AS text")
    for r in repair.damaged(turns).collect():
        act = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(act, 1) and r.role == ("user" if act == 4 else "assistant")
        assert r.text == {1: "", 2: "One Two Three"}.get(act, "One. Two? Three!")
