"""Each operator against a brute-force version, with nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.llm import bpe, chat, decontaminate, html_text, near_dedup, sharding, simhash, substrings, toxicity, warc

LAST = 2**63 - 1
DOCS = "doc_id long, text string"


def words(n, seed, size=40):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def corpus():
    base = words(60, 1, 500)
    rows = [(i, " ".join(base[: 30 + i])) for i in range(6)]
    rows += [(10 + i, " ".join(words(20, 5 + i)) + "\n" + " ".join(base[5:25])) for i in range(5)]
    rows += [(20, " ".join(["x"] * 60)), (21, " ".join(["x"] * 30)), (22, "one two"), (23, "one two"), (24, ""), (25, None), (None, " ".join(base)), (None, None), (3, "other text of the same id"), (26, "ONE two"), (27, "  \t\n ")]
    return rows


# Toxicity.


def toxic_texts(n, seed):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        ws = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(r.randrange(5, 90))]
        y = int(i % 4 == 0)
        if y:
            ws[r.randrange(len(ws))] = r.choice(["zork", "zorkish", "zork" + r.choice("abcdefgh") * 2, "Vlim!"])
        texts.append(" ".join(ws))
        labels.append(y)
    return texts, np.array(labels)


def test_toxicity_learns_words_and_word_parts():
    model = toxicity.train(*toxic_texts(800, 1))
    texts, labels = toxic_texts(300, 2)
    predicted = model.scores(texts) >= 0.5
    assert (predicted == (labels == 1)).mean() > 0.95
    alone = model.scores(texts[:7])
    assert np.allclose(alone, model.scores(texts)[:7], atol=1e-4)
    far = " ".join(["abc"] * 500 + ["zork"] + ["abc"] * 500)  # any window counts, wherever it lies
    assert model.scores([far])[0] > 0.5 > model.scores([" ".join(["abc"] * 1001)])[0]
    assert 0 <= model.scores([""])[0] < 0.5 and len(model.scores([])) == 0
    assert model.scores(["a" * 5000 + " b"]).shape == (1,)


def test_toxicity_windows_cover_every_word():
    codes, mask, owner = toxicity.Model.windows(np.concatenate([np.arange(1, n + 1) for n in (0, 1, 31, 32, 33, 100)]), np.array([0, 1, 31, 32, 33, 100]))
    for i, n in enumerate((0, 1, 31, 32, 33, 100)):
        own = owner == i
        assert set(codes[:, own][mask[:, own] > 0].tolist()) == set(range(1, n + 1)) and own.any()


def test_toxicity_frames(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (2, None, 1.0), (2, "", 2.0)], DOCS + ", score double")
    out = toxicity.score(docs, None)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and {r.score for r in out.collect()} == {0.0}
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.train(["a"], np.array([1])) is None
    assert toxicity.held_out(7) == (zlib.crc32(b"7") % 5 == 0)


def test_toxicity_fit_takes_stretches_of_long_texts_and_repeated_rows(spark):
    texts, labels = toxic_texts(300, 3)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 2 + [(900 + i, "abc de " * 2000 + t) for i, t in enumerate(texts[:20])] + [(None, "zork"), (2000, None), (2001, "")]
    told = [(i, int(y)) for i, y in enumerate(labels)] + [(900 + i, int(y)) for i, y in enumerate(labels[:20])] + [(1, int(labels[1])), (None, 1), (2000, 1), (2001, 0), (5, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("y", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame(told, "doc_id long, toxic int"), sample_chars=500)
    out = {(r.doc_id, r.text): r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(out[i, t] == labels[i] for i, t in enumerate(texts)) > 0.9 * len(texts) and len(model.scores(["a"] * 3)) == 3


def test_toxicity_held_out_rows(spark):
    """Of the toxic rows that training never saw nine in ten are caught, and few clean ones are flagged."""
    sf = "/root/testdata/sf0.1"
    out = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("p")).collect()
    told = {r.toxic: r.p / r.n for r in out}
    assert told[1] >= 0.9 and told[0] < 0.03, told


# Substrings.


def brute_substrings(rows):
    least, split = {}, [(LAST if i is None else i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, i), i)
    out = []
    for (i, w), (own, _) in zip(split, rows, strict=True):
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 1000])
def test_substrings(spark, hot):
    rows = corpus() + [(30 + i, " ".join(words(7, 99) * (2 + i % 3))) for i in range(9)]
    got = [tuple(r) for r in substrings.dedup(spark.createDataFrame(rows, DOCS), hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == sorted(brute_substrings(rows), key=repr)


def test_substring_factors_point_to_equal_words(spark):
    rows = {i: (t or "").split() for i, t in corpus() if i is not None and i != 3}
    for r in substrings.dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], DOCS), with_factors=True).collect():
        end = 0
        for f in r.factors or ():
            assert f.start >= end and f.ref_doc_id < r.doc_id
            assert rows[r.doc_id][f.start : f.start + f.words] == rows[f.ref_doc_id][f.ref_start : f.ref_start + f.words]
            end = f.start + f.words
        assert sum(f.words for f in r.factors or ()) == r.n_removed


def test_substrings_empty_and_clashing(spark):
    assert substrings.dedup(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b", "keep", 5)], DOCS + ", th string, n_words int")
    assert substrings.dedup(df).first().asDict() == {"doc_id": 1, "text": "a b", "th": "keep", "n_words": 2, "n_removed": 0, "kept_sha256": hashlib.sha256(b"a b").hexdigest()}


# WARC.


def test_loser_tree():
    r = random.Random(3)
    for k in range(9):
        runs = [sorted(r.randrange(20) for _ in range(r.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 100
    rows = [(5, "http://b.org/x", big), (2, "http://a.org/", big), (9, None, big), (7, "http://a.org/z?q=1\r\nX: y", "small"), (8, "http://a.org/z", "small"), (1, "u", None), (None, "n", big), (2, "http://again", big), (3, "https://[bad", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    index = warc.write(pages, folder, segment=50)
    history = warc.merge(index)
    got = sorted(map(tuple, warc.read(history, folder).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [(i, size(h), sha(h), "revisit" if h == big and i != 2 else "response", 2 if h == big and i != 2 else None) for i, _, h in rows]
    assert got == sorted(want, key=repr)
    keys = [(r.url_key, r.ts, r.pid) for r in history.withColumn("p", F.spark_partition_id()).orderBy("p", "place").collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    assert warc.read(warc.merge(warc.write(pages.limit(0), str(tmp_path / "e"))), str(tmp_path / "e")).count() == 0


def test_warc_hot_payloads_and_small_ranges(spark, tmp_path):
    """Hot payloads are told by broadcast; ranges smaller than a run; extra columns; one page_id with two payloads."""
    rows = [(i, f"http://h{i % 3}.org/{i % 7}", "same " * 40 if i % 3 == 0 else f"page {i % 40} " * 20, i) for i in range(300)] + [(3, "http://x", "other " * 30, 0), (3, "http://x", "same " * 40, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = str(tmp_path / "w")
    history = warc.merge(warc.write(pages, folder, segment=3000), entries=20)
    got = sorted(map(tuple, warc.read(history, folder).collect()), key=repr)
    least = {}
    for i, _, h, _ in rows:
        least[h] = min(least.get(h, i), i)
    want = [(i, len(h), hashlib.sha256(h.encode()).hexdigest(), "response" if least[h] == i else "revisit", None if least[h] == i else least[h]) for i, _, h, _ in rows]
    assert got == sorted(want, key=repr)
    keys = [(r.url_key, r.ts, r.pid) for r in history.withColumn("p", F.spark_partition_id()).orderBy("p", "place").collect()]
    assert keys == sorted(keys) and history.rdd.getNumPartitions() == 16


# Decontamination.


def brute_contamination(docs, items):
    windows = {}
    for key, t in items:
        w = decontaminate.normalised((t or "").encode())
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(key))
    out = []
    for i, t in docs:
        w = decontaminate.normalised((t or "").encode())
        hit, found = set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1, 10**6])
def test_decontamination(spark, block):
    r = random.Random(5)
    items = [(i, " ".join(words(n, 50 + i, 4))) for i, n in enumerate((13, 14, 20, 3, 1, 2, 40, 12, 13))] + [(9, ""), (10, None), (11, "Ünï-code ONE"), (12, " ".join(words(20, 52, 4)))]
    docs = [(i, " ".join(words(200, 70 + i, 4))) for i in range(6)] + [(10, "x " + items[2][1] + " y"), (11, None), (12, ""), (13, "Zz, " + items[0][1].upper().replace(" ", "--")), (14, "ünï. code; one"), (10, "ÜnÏ code one " + r.choice("ab"))]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    got = [tuple(x) for x in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=repr) == sorted(brute_contamination(docs, items), key=repr)


def test_decontamination_spans_and_empty_tables(spark):
    item = " ".join(words(13, 1, 99))
    docs = spark.createDataFrame([(1, f"keep, this; {item.upper()}! and that"), (2, "clean")], DOCS)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs, items, with_text=True).collect()}
    assert rows[1].kept.split() == ["keep,", "this;", "!", "and", "that"] and rows[1].longest_match == 13 and rows[2].kept is None
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_decontamination_one_automaton_at_a_time(spark):
    """Many blocks, clashing columns, short items without an id that equal others, a long text."""
    items = [(i if i % 3 else None, " ".join(words(1 + i % 30, 900 + i % 11, 6))) for i in range(40)]
    docs = [(i, " ".join(words(150, 950 + i, 6))) for i in range(6)] + [(7, " ".join(words(30_000, 3, 6)))]
    df = spark.createDataFrame(docs, DOCS).withColumn("k", F.lit(1)).withColumn("n_hit", F.lit("old")).withColumn("item_id", F.lit(5))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("t", F.lit("x"))
    some = [decontaminate.decontaminate(df, benchmark, block_words=n).select("doc_id", "n_hit", "n_items", "items_sha256", "k").collect() for n in (1, 25, 10**6)]
    assert sorted(some[0]) == sorted(some[1]) == sorted(some[2])
    listed = brute_contamination(docs, [(i, t) for i, t in items if i is not None])
    assert {r.doc_id: r.items_sha256 for r in some[0]} == {x[0]: x[4] for x in listed}
    assert {r.doc_id: r.n_hit for r in some[0]} == {x[0]: x[2] for x in brute_contamination(docs, items)}


# Chat.


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "<\\|", "<\\\\|<|", "<|turn|>", "a\\<|b", "", "é\n\n", "|>", "<", "\\|"]
    rows = [(1, i, ("user", "assistant", "assistant", "sys\\tem<|\nx")[i % 4], t) for i, t in enumerate(nasty)] + [(2, 0, "user", None), (2, None, None, "null turn"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, 1, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (1, 2, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, _, r, x in own]
        assert "".join(s.text for s in back[conv].segments) == back[conv].formatted
    assert back[1].formatted.count("<|im_start|>") < len(nasty)  # neighbours of one role share a block
    assert chat.format_conversations(df.limit(0)).count() == 0
    merged = df.withColumn("t", F.lit("clash")).withColumn("formatted", F.lit(1))
    assert {r.conv_id: r.formatted for r in chat.format_conversations(merged).collect()} == {i: r.formatted for i, r in back.items()}
    long = spark.range(5000).select(F.lit(7).alias("conv_id"), "id", F.when(F.col("id") % 900 < 880, "user").otherwise("assistant").alias("role"), F.lit("<|x").alias("text"))
    one = chat.read_back(chat.format_conversations(long, turn="id")).first()
    assert len(one.turns) == 5000 and one.formatted.count("<|im_start|>") == 11 and {t.text for t in one.turns} == {"<|x"}


# SimHash.


def test_simhash_fingerprints_and_next(spark):
    rows = [(i, t) for i, t in corpus() if i is not None and i != 3]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in simhash.report(simhash.fingerprints(docs)).collect()}
    ordered = sorted(rows, reverse=True)
    by_text = {}
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        follow = out[ordered[(k + 1) % len(ordered)][0]].fingerprint
        near = 1 - bin(int(out[i].fingerprint, 16) ^ int(follow, 16)).count("1") / 64
        assert abs(out[i].near_next - near) < 1e-12
        assert by_text.setdefault(t, out[i].fingerprint) == out[i].fingerprint
    assert len(set(by_text.values())) >= len(by_text) - 2
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "q")], DOCS)
    assert simhash.report(simhash.fingerprints(twice)).count() == 4
    assert simhash.report(simhash.fingerprints(docs.limit(0))).count() == 0


def test_simhash_votes(spark):
    """The fingerprints recomputed one vote at a time."""
    import xxhash

    def vote(text):
        w = text.split()
        h = [xxhash.xxh64(b.encode(), seed=xxhash.xxh64(a.encode(), seed=42).intdigest()).intdigest() for a, b in zip(w, w[1:], strict=False)]
        h = h or [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    rows = [(i, t) for i, t in corpus() if i is not None and i != 3] + [(70, " ".join(words(30_000, 5, 3000)))]
    ordered = sorted(rows, reverse=True)
    for r in simhash.report(simhash.fingerprints(spark.createDataFrame(rows, DOCS).withColumn("th", F.lit("clash")))).collect():
        k = [i for i, _ in ordered].index(r.doc_id)
        t, after = ordered[k][1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        assert r.fingerprint == f"{vote(t):016x}" and r.edited_fingerprint == f"{vote(t[: len(t) - half] + after[:half]):016x}"


def test_block_tables_find_all(spark):
    r = random.Random(8)
    fps = [r.getrandbits(63) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in r.sample(range(63), d)) for f in fps[:30] for d in (1, 2, 3, 4)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(x.ask, x.fp) for x in simhash.within(df, df, 3).collect()}
    assert got == {(a, b) for a in set(fps) for b in set(fps) if a != b and bin(a ^ b).count("1") <= 3}


# Sharding.


def best_fit(units, capacity):
    """One unit after the other, the plain way: (size, bin) of each, and the number of bins."""
    free, placed = [], []
    for size in sorted(units, reverse=True):
        fits = [b for b in range(len(free)) if free[b] >= size]
        b = min(fits, key=lambda x: (free[x], x)) if fits else len(free)
        if not fits:
            free.append(capacity)
        free[b] -= size
        placed.append((size, b))
    return sorted(placed), len(free)


def test_packing():
    r = random.Random(4)
    for most in (8, 60, 90):
        for _ in range(30):
            units = [r.randrange(1, most) for _ in range(r.randrange(1, 80))]
            runs, bins = sharding.pack([(u, units.count(u)) for u in set(units)], 60)
            assert (sorted((size, at) for size, first, end, at in runs for _ in range(first, end)), bins) == best_fit(units, 60)
            spread = sharding.balance([(u, units.count(u)) for u in set(units)], 5)
            assert sorted(size for size, first, end, _ in spread for _ in range(first, end)) == sorted(units)
            for u in set(units):
                own = sorted((first, end) for size, first, end, _ in spread if size == u)
                assert own[0][0] == 0 and own[-1][1] == units.count(u) and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("n", [40, 700])
def test_every_group_is_packed_at_every_size(spark, n):
    r = random.Random(n)
    rows = [(i, "x" * r.randrange(1, 30) + str(i % (n // 2))) for i in range(n)]
    out = sharding.assign(spark.createDataFrame(rows, DOCS), capacity=500, ranked=3, stretches=2, carry=("text",)).collect()
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t) + 8
    placed, bins = best_fit(list(groups.values()), 500)
    where = {x.text: x.shard for x in out}
    assert sorted((size, where[t]) for t, size in groups.items()) == placed and len(set(where.values())) == bins
    for shard in set(where.values()):
        assert sorted(x.slot for x in out if x.shard == shard) == list(range(sum(x.shard == shard for x in out)))


def test_sharding(spark):
    rows = [(i, "t" * (i % 37)) for i in range(300)] + [(1000 + i, "copy " * 20) for i in range(100)] + [(None, None), (5, "again"), (5, "again"), (7, "")]
    out = sharding.assign(spark.createDataFrame(rows, DOCS), shards=4, hot=10, carry=("text",)).collect()
    assert len(out) == len(rows)
    by_text, slots = {}, {}
    for r in out:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert by_text.setdefault(r.text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    # The copies outweigh a shard and stand alone; the others share the rest evenly.
    assert sum(s > 3000 for s in sizes) == 1 and max(sorted(sizes)[:3]) - min(sizes) < 0.02 * sorted(sizes)[2]
    light = [r for r in rows if not (r[1] or "").startswith("copy")]
    even = [r["sum(size)"] for r in sharding.assign(spark.createDataFrame(light, DOCS), shards=4).groupBy("shard").sum("size").collect()]
    assert len(even) == 4 and max(even) - min(even) < 0.02 * max(even)
    assert sharding.assign(spark.createDataFrame([], DOCS)).count() == 0


# BPE.


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.public_tokenizer()[0])


def test_bpe_equals_the_library(library):
    path, pattern = bpe.public_tokenizer()
    with open(path, encoding="utf-8") as f:
        own = bpe.codec(f.read(), pattern)
    r = random.Random(6)
    parts = [" ", "  ", "\n", "\t", " ", "　", "a", "Bc", "é", "1", "½", "一", "'s", "'ll", "!", "<|endoftext|>", "́", "😀", "\x1c", "_", "the", "​", "٣"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(15))) for _ in range(3000)] + ["", "ab" * 2000 + "é" * 300, " " * 500 + "x", "The cat, sat. on it!"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        mine = own.encode(t)
        assert np.frombuffer(mine, np.uint32).tolist() == ids, t
        assert own.decode(mine) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_frames(spark, library):
    df = spark.createDataFrame([(1, "Hello world", 3), (2, None, 4), (2, "", 5)], DOCS + ", n_tokens int")
    rows = bpe.encode(df, *bpe.public_tokenizer(), with_text=True).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in rows) == [(1, 2, "Hello world"), (2, 0, ""), (2, 0, "")]
    assert bpe.encode(df.limit(0), *bpe.public_tokenizer()).count() == 0


# Near duplicates.


def brute_near(rows, share=85):
    """Rows without an id are documents by themselves; rows that share one are one document."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, n, own = {}, [], []
    for k, (i, t) in enumerate(rows):
        w = (t or "").translate(lower).split()
        s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        own.append((i is None, k if i is None else i))
        n.append(len(s))
        sets.setdefault(own[-1], []).append(s)
    nodes = sorted(sets)
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and any(x and y and 100 * len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    out = []
    for (i, _), k, node in zip(rows, n, own, strict=True):
        none, c = find(node)
        out.append((i, k, None if none else c, none if i is None else (False, i) == (none, c)))
    return out


def near_corpus():
    r = random.Random(7)
    rows = []
    for g in range(4):
        base = words(120, 200 + g, 2000)
        for k in range(9):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(w)))
    return rows


def test_near_duplicates(spark):
    rows = near_corpus() + [(900, "one two"), (901, "ONE two"), (902, ""), (903, None), (904, " \n"), (905, near_corpus()[0][1].upper()), (None, "lone null id text here now"), (906, "Éa b c d e"), (907, "éa b c d e")]
    got = [tuple(x) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(brute_near(rows), key=repr)


def same_near(spark, rows, **how):
    """The result is the brute-force one, whatever columns come along."""
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    want = sorted(brute_near(rows, how.get("share", 85)), key=repr)
    df = spark.createDataFrame(rows, DOCS)
    for docs in (df, df.withColumn("rep", F.lit("x")).withColumn("kept", F.lit(3))):
        assert sorted((tuple(x) for x in near_dedup.near_duplicates(docs, **how).select(*columns).collect()), key=repr) == want


def test_near_duplicates_repeated_and_missing_ids(spark):
    x, y = " ".join(words(50, 1, 900)), " ".join(words(50, 2, 900))
    same_near(spark, [(3, x), (5, x), (5, y), (7, y)])
    same_near(spark, [(None, x), (None, x), (None, y), (None, None), (None, ""), (8, ""), (8, y), (9, None), (9, None), (4, y + " more"), (6, x), (6, x)])
    same_near(spark, [(2**62 + 5, x), (-4, x + " tail"), (-4, ""), (None, x), (2, "long " * 20_000 + x), (1, "Long " * 20_000 + x)])


def test_near_duplicates_one_row_of_each_component(spark):
    x, y, z = (" ".join(words(50, k, 900)) for k in (1, 2, 3))
    rows = [(3, x), (3, x), (5, x), (5, y), (7, y), (None, z), (None, z), (None, z + " a"), (None, ""), (None, None), (8, ""), (8, ""), (9, "q"), (9, "r"), (None, "q")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], DOCS + ", extra int")
    out = near_dedup.near_duplicates(df, once=True).collect()
    assert len(out) == len(rows)
    stays = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out if r.stays and r.n_shingles)
    assert [i for i, _ in stays] == [-1, 3, 9] and sum(r.stays for r in out if not r.n_shingles) == 3


def test_blocks_of_unlinked_documents_lose_no_link(spark):
    """Documents of one template share bands, but few of them are linked; the blocks are made small."""
    r = random.Random(12)
    base = words(200, 77, 5000)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice((2, 6, 9))):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    old = near_dedup.Links.rest
    try:
        near_dedup.Links.rest = lambda self: old(self, block=1500)
        same_near(spark, rows)
    finally:
        near_dedup.Links.rest = old


def test_near_duplicates_carries_columns(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "x", 1), (1, "A b c d e f", "y", 2), (3, None, "z", 3)], DOCS + ", rep string, kept int")
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    assert (rows[2].component_id, rows[2].kept, rows[2].rep, rows[1].kept, rows[3].component_id) == (1, False, "x", True, 3)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimate_is_close():
    from pairlight.llm.shingles import Sketcher

    r = np.random.default_rng(1)
    s = Sketcher(24, 5)
    x = np.sort(r.integers(0, 2**63, 1000, dtype=np.uint64))
    y = np.sort(np.concatenate([x[:900], r.integers(0, 2**63, 100, dtype=np.uint64)]))
    packed = [s.packed(s.minima(v, np.array([0, len(v)])))[0] for v in (x, y)]
    assert abs(s.similarity(*packed) - 900 / 1100) < 0.15


# HTML.


@pytest.fixture(scope="module")
def model():
    return html_text.trained(300, 80)


def test_html_main_text(model):
    page = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=\"cookie-notice\">We use cookies here.</div><article><h1>A &amp; B</h1><p>First <b>bo</b>ld\n  text &lt;ok&gt; with words enough to be read as text.<p>Second &eacute; paragraph, also of a fair length for a page.<br>After</article><div class=\"comments\"><p>A reader says something long enough to look real.</p></div><footer>&copy; Someone</footer>"
    assert model.texts([page]) == ["A & B First bold text <ok> with words enough to be read as text. Second é paragraph, also of a fair length for a page. After"]
    assert model.texts(["", "<", "<!-- open", "plain < text &am"])[0] == ""


def test_html_malformed_attributes_and_lists_of_links(model):
    said = "a long sentence that has words enough to be read as text, and then some more of them"
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head</h1>{}<p>Last paragraph, also of a fair length for any page.</p></article></body>"
    end = " Last paragraph, also of a fair length for any page."
    for inner in (f"<p title=it's>{said}, don't you think</p>", f"<p title='it\"s' data-x=\"a>b\">{said}, don't you think</p>", f"<p title=\"unclosed>{said}, don't you think</p>", f"<p title=x'y\"z >{said}, don't you think", f"<p/>{said}, don't you think</ p>", f"<p a=b/c=\"d\"e='f'>{said}, don't you think</p>", f"<p = a\n=\n'b'>{said}, don't you think<!--> --></p>"):
        got = model.texts([page.format(inner)])[0].replace(" -->", "")
        assert got == f"Head {said}, don't you think{end}", inner
    listed = "<ul>" + "".join(f'<li><a href="/{i}">The linked item number {i}</a></li>' for i in range(4)) + "</ul>"
    assert model.texts([page.format(f"<p>{said}.</p>{listed}")])[0] == f"Head {said}. " + " ".join(f"The linked item number {i}" for i in range(4)) + end
    assert model.texts([page.format(f"<p>{said}.</p>")] * 2) == [f"Head {said}.{end}"] * 2
    assert len(model.texts([page.format(f"<p>{said}.</p>" * 20_000)])[0]) > 1_500_000


def test_html_hand_labelled_pages(model):
    """Pages written by hand, unlike those that the model is trained on."""
    text = "Rain fell over the harbour all night and the boats stayed where they were until the morning."
    pages = [
        (f'<html><body class="single-post"><div id="page"><div id="masthead"><a href="/">The Paper</a></div><div class="entry-content"><p>{text}</p><figure><img src=x><figcaption>The harbour at dawn</figcaption></figure><p>{text}</p></div><div id="sidebar"><h4>Most read</h4><ol><li><a href=1>One</a></li><li><a href=2>Two</a></li></ol></div><div id="footer">Imprint | Privacy</div></div></body></html>', f"{text} The harbour at dawn {text}"),
        (f'<body><header><h2>Site name</h2></header><main><article><h1>Title</h1><p>{text}</p><blockquote>{text}</blockquote><aside class="related"><a href=/a>Read this too</a></aside></article></main><section id="comments"><h3>2 comments</h3><p>I was there and it was nothing like that at all.</p></section><footer><p>Copyright</p></footer>', f"Title {text} {text}"),
        (f'<body><div class="cookie-consent"><p>We value your privacy and use cookies.</p><button>OK</button></div><form action=/s><input name=q><button>Search</button></form><div class="article-body"><h2>Storm</h2>{text}<br>{text}<pre>a  b</pre></div><noscript>Turn on scripts</noscript></body>', f"Storm {text} {text} a b"),
    ]
    assert model.texts([p for p, _ in pages]) == [t for _, t in pages]


def test_html_held_out_pages(model):
    import re

    right = total = 0
    for source, want in html_text.labelled_pages(120, 999):
        got = [w.lower() for w in re.findall(r"\w+", model.texts([source])[0])]
        want = [w.lower() for w in want]
        right += len(set(got) & set(want)) - len(set(got) - set(want))
        total += len(set(want))
    assert right / total > 0.9


def test_sum_product_is_exact(model):
    pages = [html_text.Page("<div><p>a</p><ul><li>b</ul></div>")]
    forest = html_text.Forest(pages, model.known)
    r = np.random.default_rng(0)
    weights, edge = r.standard_normal(len(model.known)), r.standard_normal((html_text.KINDS, 2, 2))
    p, _ = forest.marginals(weights, edge)
    score = np.bincount(forest.node, weights[forest.feature], minlength=forest.n)
    total, on = 0.0, np.zeros(forest.n)
    for state in range(2**forest.n):
        y = [(state >> i) & 1 for i in range(forest.n)]
        e = np.exp(sum(score[i] * y[i] for i in range(forest.n)) + sum(edge[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, forest.n)))
        total += e
        on += e * np.array(y)
    assert np.allclose(p, on / total)


def test_html_frames(spark, model):
    df = spark.createDataFrame([(1, "u", "<article><p>some words of text</p></article>", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_text.extract(df, model=model).collect()}
    assert (rows[1].text, rows[1].n_chars, rows[2].text, rows[2].n_chars) == ("some words of text", 18, "", 0)
    assert html_text.extract(df.limit(0), model=model).count() == 0


def test_substrings_long_repeated_and_crowded(spark):
    r = random.Random(31)
    lines = [" ".join(words(15, 400 + i, 900)) for i in range(30)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9))) + f" own{i} " + " ".join(words(9, 700 + i, 900))) for i in range(150)]
    rows += [(500, " ".join(words(60_000, 41, 30)) + " " + lines[0]), (501, " ".join(words(60_000, 41, 30))), (502, "z" * 300_000 + " " + lines[1])]
    rows += [rows[3]] * 3 + [(7, lines[2] + " " + lines[2]), (7, lines[2] + " " + lines[2]), (None, lines[3]), (None, lines[3])]
    for hot in (3, 200):
        got = [tuple(x) for x in substrings.dedup(spark.createDataFrame(rows, DOCS), hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert sorted(got, key=repr) == sorted(brute_substrings(rows), key=repr)


def test_the_parse_covers_what_its_pointers_do():
    r = random.Random(32)
    for _ in range(300):
        n = r.randrange(13, 90)
        pointers = [(s, k, r.randrange(3), s + r.choice((0, 5))) for s in (r.randrange(n - 12) for _ in range(r.randrange(6))) for k in (r.randrange(1, n - 12 - s + 1),)]
        factors, removed = substrings.parse(n, pointers)
        want = {w for s, k, _, _ in pointers for w in range(s, s + k + 12)}
        assert {i for i, x in enumerate(removed) if x} == want == {w for s, k, _, _ in factors for w in range(s, s + k)}
        assert sum(f[1] for f in factors) == len(want)
