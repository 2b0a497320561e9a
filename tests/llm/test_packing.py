"""Mixture-controlled packing against one-at-a-time deficits, and ids against the library."""

from __future__ import annotations

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import tokenizers

from pairlight.llm import packing
from pairlight.llm.packing import Dealer, WordIds, plan, rounds

PATH = packing.public_tokenizer()


def test_words_are_the_librarys():
    own, library = WordIds(PATH), tokenizers.Tokenizer.from_file(PATH)
    ids = lambda t: np.frombuffer(own(t), own.dtype).tolist()
    for c in range(0x2FF):  # every character that isn't left to the library, and some that are
        for text in (f"a{chr(c)}b {chr(c)}{chr(c)}", f"{chr(c)}'s9{chr(c)}", f"don't {chr(c).upper()}x"):
            assert ids(text) == library.encode(text, add_special_tokens=False).ids, hex(c)
    draw = random.Random(7)
    letters = "abcXYZéßœİ 0123'!?.,\t\n\x85\xa0<|>Σǆ漢́"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
        assert ids(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("<|endoftext|>", "x<|startoftext|>y", "<|END", "", " "):
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_rounds_carry_the_deficit():
    """A queue's deficit, kept as a fraction and carried window by window, gives what the formula gives from anywhere."""
    draw = random.Random(3)
    for _ in range(200):
        windows = draw.randrange(1, 60)
        quantum, deficit, given = draw.randrange(5000), Fraction(0), [0]
        for _ in range(windows):
            deficit += Fraction(quantum, windows)
            take = deficit.numerator // deficit.denominator
            deficit -= take
            given.append(given[-1] + take)
        at = draw.randrange(windows + 1)
        assert rounds(quantum, windows, at, windows - at).tolist() == given[at:]
    assert rounds(3 * 2**45 // 2048, 2**34, 2**33, 1)[0] == 3 * 2**45 // 2048 // 2  # 100 TB of text


@pytest.mark.parametrize("weights", [None, [5, 3, 1], [1, 1, 0]])
def test_every_window_has_its_mixture(weights):
    totals, window = [5000, 777, 2001], 64
    phases = plan(totals, weights, window)
    assert [sum(p[3][q] for p in phases) for q in range(3)] == totals
    cells = [[(w, o, b - a) for w, o, a, b in zip(*(x.tolist() for x in (p[2], p[3], p[0], p[1])), strict=True)] for q in range(3) for p in Dealer(phases, 3).places(q, 0, totals[q])]
    filled: dict[int, list] = {}
    for w, o, n in (c for cell in cells for c in cell):
        filled.setdefault(w, []).append((o, n))
    sizes = []
    for w in sorted(filled):
        at = 0
        for o, n in sorted(filled[w]):
            assert o == at
            at += n
        sizes.append(at)
    assert [*filled] and sorted(filled) == list(range(len(filled)))
    full = sum(s == window for s in sizes)
    assert full == sum(totals) // window and all(s & (s - 1) == 0 for s in sizes[full:])
    if weights is None:  # within a token of the target after any number of windows
        so_far = [0, 0, 0]
        places = [{int(w): int(b - a) for p in Dealer(phases, 3).places(q, 0, totals[q]) for a, b, w in zip(p[0], p[1], p[2], strict=True)} for q in range(3)]
        share = [Fraction(n, phases[0][1]) for n in phases[0][3]]
        for w in range(full):
            for q in range(3):
                so_far[q] += places[q].get(w, 0)
                assert abs(so_far[q] - (w + 1) * share[q]) < 1
    else:
        first = {q: sum(int(b - a) for p in Dealer(phases, 3).places(q, 0, totals[q]) for a, b, w in zip(p[0], p[1], p[2], strict=True) if w == 0) for q in range(3)}
        assert all(abs(first[q] - Fraction(window * weights[q], sum(weights))) < 1 for q in range(3))


def test_a_stretch_is_dealt_like_the_whole():
    totals = [4000, 901, 90]
    dealer = Dealer(plan(totals, None, 128), 3)
    for q in range(3):
        whole = {}
        for a, b, w, o in dealer.places(q, 0, totals[q]):
            for x, y, v, z in zip(a.tolist(), b.tolist(), w.tolist(), o.tolist(), strict=True):
                whole |= {i: (v, z + i - x) for i in range(x, y)}
        assert sorted(whole) == list(range(totals[q]))
        draw = random.Random(q)
        for _ in range(40):
            low, high = sorted(draw.sample(range(totals[q] + 1), 2))
            got = {i: (v, z + i - x) for a, b, w, o in dealer.places(q, low, high) for x, y, v, z in zip(a.tolist(), b.tolist(), w.tolist(), o.tolist(), strict=True) for i in range(x, y)}
            assert got == {i: whole[i] for i in range(low, high)}


def test_too_small_a_weight():
    with pytest.raises(ValueError, match="less than a token"):
        plan([10**6, 10**6], [10_000, 1], 2048)


def _check(pieces, texts, window):
    library = tokenizers.Tokenizer.from_file(PATH)
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in texts.items()}
    rest = {i: 0 for i in texts}
    for r in sorted(pieces, key=lambda r: (str(r.doc_id), r.start)):
        assert r.start == rest[r.doc_id] and 4 * r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        rest[r.doc_id] += r.length
    assert all(4 * n == len(ids[i]) for i, n in rest.items())
    at: dict[int, int] = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n == window or n & (n - 1) == 0 for n in at.values()) and sorted(at) == list(range(len(at)))
    return at


def test_pack_documents(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(["Alpha", "beta,", "ГАММА", "d'accord", "x1"]) for _ in range(draw.randrange(60))), draw.choice(["a", "b", "b", "b", None]), "clash", 1) for i in range(300)]
    rows += [(1000, None, "a", "", 1), (1001, "", None, "", 1), (None, "word " * 5000, "tiny", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string, `__text` int").repartition(5)
    texts = {r[0]: r[1] for r in rows}
    got = packing.pack(docs, PATH, window=256, with_ids=True).collect()
    at = _check(got, texts, 256)
    mixed = packing.pack(docs, PATH, weights={"b": 2.0, None: 1.0}, window=256).collect()
    _check(mixed, texts, 256)
    first = {s: sum(r.length for r in mixed if r.sequence_id == 0 and r.source == s) for s in ("b", None)}
    assert abs(first["b"] - 256 * 2 / 3) < 1 and first["b"] + first[None] == 256
    whole = packing.sequences(spark.createDataFrame(got), 256).collect()
    assert {r.sequence_id: r.n_tokens for r in whole} == at and all(len(r.ids) == 4 * r.n_tokens and r.padding == 0 for r in whole)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_many_small_sources_share_a_queue(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "'one two three' AS text", "cast(id AS string) AS source")
    got = packing.pack(docs, PATH, window=64).collect()
    _check(got, dict.fromkeys(range(600), "one two three"), 64)
