"""Toxicity scores from a recurrent network over characters and words.

A word's vector is made by a bidirectional gated recurrent network over its
characters with attention pooling, joined with an embedding of the word; so words
never seen in training have vectors as well. A second such network reads windows
of ``WINDOW`` words that overlap by a quarter and cover the whole text. A document's
score is that of its highest window, calibrated. Both networks are trained here,
in numpy, with gradients written out.

Training sees a sample of labelled texts that is bounded by ``SAMPLE`` rows of each
label; rows are chosen by a hash of their id. Of a text above ``SAMPLE_CHARS``
characters a stretch of so many is taken, at a place that its hash chooses, so
that long texts are learned and calibrated on as well. Inputs are texts alone. As labels belong to documents, not to words, the
character network learns from the words that stand in toxic documents alone and show
strong statistical evidence, by themselves or by a run of characters.

Null or empty text, or one without words: the median score of clean training texts. Very
long words are read in pieces of ``CHARS`` characters. Null labels aren't trained
on. Without rows of both labels the score is 0 throughout. Repeated rows: one
score each. Extra columns pass through ``score``, whose columns replace theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.llm.recurrent import Adam, Encoder, sigmoid
from pairlight.llm.text import slices, tidy

WINDOW, STRIDE = 32, 24
CHARS = 24
SAMPLE, SAMPLE_CHARS = 1500, 6000
SAMPLE_WORDS, BATCH, HARD = 20_000, 128, 400
#: Characters in the runs that may mark a toxic word, and the evidence they need.
GRAM, LONGER, SIGN = 4, (5, 6, 7, 8), 20.0
ALPHABET = 256
#: Words in so many training texts have embeddings of their own.
OWN = 3
MARKS = ".,;:!?\"'()[]{}<>#&$%*~^_+=|\\/@`-"
CACHE = 250_000


def pieces(token: str) -> list[str]:
    """A token's normalised form, in pieces of at most CHARS characters."""
    word = token.strip(MARKS).lower() or token
    return [word] if len(word) <= CHARS else [word[i : i + CHARS] for i in range(0, len(word), CHARS)]


class Model:
    def __init__(self, seed: int = 1) -> None:
        rng = np.random.Generator(np.random.Philox(key=seed))
        self.letters = (rng.standard_normal((ALPHABET, 8)) * 0.5).astype(np.float32)
        self.chars = Encoder(8, 12, 8, rng)
        self.head = {"w": np.zeros(24, np.float32), "b": np.zeros(1, np.float32)}
        self.narrow = (rng.standard_normal((24, 8)) / 5).astype(np.float32)
        #: Row 0 is for words without an embedding of their own.
        self.embedding = np.zeros((1, 4), np.float32)
        self.vocabulary: dict[str, int] = {}
        self.words = Encoder(13, 8, 8, rng)
        self.out = {"w": np.zeros(16, np.float32), "b": np.zeros(1, np.float32)}
        self.scale = np.array([1.0, 0.0])
        #: The logit of an empty window.
        self.blank = np.float32(-1)
        self.rows = np.zeros((0, 2, 24), np.float32)
        self.forget()

    # Characters.

    @staticmethod
    def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, n) letter codes and mask."""
        steps = max(1, max(map(len, words)))
        codes, mask = np.zeros((steps, len(words)), np.int64), np.zeros((steps, len(words)), np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        who = np.repeat(np.arange(len(words)), lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes[at, who] = np.where(flat < 128, flat, 128 + flat * 7919 % 127)
        mask[at, who] = 1
        return codes, mask

    def char_pool(self, words: list[str], tape: dict | None = None) -> np.ndarray:
        codes, mask = self.spelled(words)
        if tape is not None:
            tape |= {"codes": codes, "x": self.letters[codes]}
        per_letter = self.chars.project(self.letters)
        return self.chars.pool(per_letter[0][codes], per_letter[1][codes], mask, tape)

    def by_length(self, words: list[str], size: int) -> Iterator[np.ndarray]:
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for at in range(0, len(order), size):
            yield order[at : at + size]

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.float32)
        for own in self.by_length(words, 4096):
            out[own] = self.char_pool([words[i] for i in own]) @ self.head["w"] + self.head["b"]
        return out

    def train_chars(self, toxic: list[str], clean: list[str], steps: int, rate: float, rng: np.random.Generator) -> None:
        """Balanced batches: toxic words, and a stretch of the clean ones by length."""
        adam = Adam(rate)
        clean = sorted(clean, key=len)
        for _ in range(steps):
            at = int(rng.integers(0, max(1, len(clean) - BATCH)))
            words = [toxic[i] for i in rng.integers(0, len(toxic), BATCH)] + clean[at : at + BATCH]
            target = np.concatenate([np.ones(BATCH), np.zeros(len(words) - BATCH)]).astype(np.float32)
            tape: dict = {}
            pooled = self.char_pool(words, tape)
            d = (sigmoid(pooled @ self.head["w"] + self.head["b"]) - target) / len(words)
            grads, dx = self.chars.back(d[:, None] * self.head["w"], tape, tape["x"])
            dl = np.zeros_like(self.letters)
            np.add.at(dl, tape["codes"], dx)
            adam.step(self.chars.p | {"hw": self.head["w"], "hb": self.head["b"], "letters": self.letters}, grads | {"hw": pooled.T @ d, "hb": np.array([d.sum()], np.float32), "letters": dl})

    # Words and windows.

    def vectors(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 13), np.float32)
        for own in self.by_length(words, 4096):
            pooled = self.char_pool([words[i] for i in own])
            out[own, :8] = np.tanh(pooled @ self.narrow)
            out[own, 8] = np.tanh((pooled @ self.head["w"] + self.head["b"]) / 4)
        out[:, 9:] = self.embedding[[self.vocabulary.get(w, 0) for w in words]]
        return out

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the kept gate inputs, for all words of all texts in order, and how many each text has; unknown words are added together."""
        split = [t.split() for t in texts]
        tokens = [t for ts in split for t in ts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        fresh = set(tokens).difference(self.known)
        if len(self.known) + len(fresh) > CACHE and self.known:
            self.forget()
            fresh = set(tokens)
        if fresh:
            cut = {t: pieces(t) for t in fresh}
            units = list(dict.fromkeys(p for ps in cut.values() for p in ps))
            base = self.add(np.stack(self.words.project(self.vectors(units)), axis=1))
            place = {p: base + i for i, p in enumerate(units)}
            for token, ps in cut.items():
                if len(ps) == 1:
                    self.known[token] = place[ps[0]]
                else:  # a very long word is several units, told apart by a negative code
                    self.known[token] = -1 - len(self.long)
                    self.long.append([place[p] for p in ps])
        flat = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            parts = [self.long[-1 - c] for c in flat[odd].tolist()]
            length = np.ones(len(flat), np.int64)
            length[odd] = list(map(len, parts))
            first = np.concatenate([[0], np.cumsum(length)])
            ends = np.concatenate([[0], np.cumsum(counts)])
            counts = first[ends[1:]] - first[ends[:-1]]
            flat = np.repeat(flat, length)
            for i, units in zip(odd.tolist(), parts, strict=True):
                flat[first[i] : first[i + 1]] = units
        return flat, counts

    def forget(self) -> None:
        self.known, self.long, self.used = {}, [], 0

    def add(self, made: np.ndarray) -> int:
        """Keep gate inputs; returns the first one's row."""
        base = self.used
        if base + len(made) > len(self.rows):
            grown = np.zeros((max(base + len(made), 2 * len(self.rows)), 2, 24), np.float32)
            grown[:base] = self.rows[:base]
            self.rows = grown
        self.rows[base : base + len(made)] = made
        self.used = base + len(made)
        return base

    @staticmethod
    def windows(flat: np.ndarray, counts: np.ndarray, only: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, n) codes and mask of all overlapping windows (or of ``only`` some), and the text of each window; a text without words has one empty window."""
        each = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
        owner = np.repeat(np.arange(len(counts)), each)
        first = np.concatenate([[0], np.cumsum(counts)])
        nth = (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))[only]
        owner = owner[only]
        at = (nth * STRIDE)[None] + np.arange(WINDOW)[:, None]
        mask = (at < counts[owner][None]).astype(np.float32)
        index = np.where(mask > 0, first[owner][None] + at, 0)
        return (flat[index] if len(flat) else np.zeros_like(index)), mask, owner

    def window_logits(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.empty(codes.shape[1], np.float32)
        for lo in range(0, codes.shape[1], 2048):
            c, m = codes[:, lo : lo + 2048], mask[:, lo : lo + 2048]
            if self.used:
                x = self.rows[c]
                pooled = self.words.pool(x[:, :, 0], x[:, :, 1], m)
            else:
                pooled = self.words.pool(*(np.zeros((*c.shape, 24), np.float32),) * 2, m)
            out[lo : lo + 2048] = np.where(m[0] > 0, pooled @ self.out["w"] + self.out["b"], self.blank)
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window's logit of each text."""
        out = np.zeros(len(texts), np.float32)
        for lo in range(0, len(texts), 500):
            codes, mask, owner = self.windows(*self.codes(texts[lo : lo + 500]))
            out[lo : lo + 500] = np.maximum.reduceat(self.window_logits(codes, mask), np.flatnonzero(np.diff(owner, prepend=-1)))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.logits(texts).astype(np.float64) + self.scale[1])))

    def train_windows(self, words: list[str], codes: np.ndarray, mask: np.ndarray, target: np.ndarray, epochs: int, rate: float, rng: np.random.Generator) -> None:
        vectors = self.vectors(words)
        bucket = np.array([self.vocabulary.get(w, 0) for w in words])
        adam = Adam(rate)
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for at in range(0, len(order), 256):
                own = order[at : at + 256]
                vectors[:, 9:] = self.embedding[bucket]
                x, m, tape = vectors[codes[:, own]], mask[:, own], {}
                pooled = self.words.pool(*self.words.project(x), m, tape)
                d = (sigmoid(pooled @ self.out["w"] + self.out["b"]) - target[own]) / len(own)
                grads, dx = self.words.back(d[:, None] * self.out["w"], tape, x)
                de = np.zeros_like(self.embedding)
                np.add.at(de, bucket[codes[:, own]], dx[:, :, 9:] * m[:, :, None])
                adam.step(self.words.p | {"ow": self.out["w"], "ob": self.out["b"], "e": self.embedding}, grads | {"ow": pooled.T @ d, "ob": np.array([d.sum()], np.float32), "e": de})


def evidence(has: tuple[np.ndarray, np.ndarray], held: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The highest signed G statistic among each word's features, by the documents that have them.

    ``has``: the words' features one behind the other, and where each word's begin; ``held``: words of each document.
    """
    flat, first = has
    counts = np.zeros((2, 1 + int(flat.max(initial=0))))
    for own, y in zip(held, labels, strict=True):
        if len(own):
            each = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(each) + each, each) + np.arange(each.sum())
            counts[int(y), np.unique(flat[at])] += 1
    total = np.bincount(labels.astype(np.int64), minlength=2).astype(np.float64)
    base = total[1] / total.sum()
    clean, toxic = counts
    n = clean + toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * base)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - base))), 0))
    g[toxic < n * (0.5 + base / 2)] = 0
    return np.maximum.reduceat(g[flat], first[:-1])


def runs(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of ``size`` characters of each word behind an edge sign (of a shorter word: the whole), and where each word's begin."""
    codes = np.frombuffer("".join(f"^{w}{chr(0) * size}" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(lengths + size) - lengths - size
    each = np.maximum(1, lengths - size + 1)
    first = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(start - first[:-1], each) + np.arange(first[-1])
    mixed = np.zeros(len(at), np.uint64)
    for j in range(size):
        mixed = (mixed ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed, return_inverse=True)[1], first


def signs(words: list[str], held: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Whether each word strongly marks toxic documents: by itself, by a longer run of characters, or, in documents that no word by itself explains, by a run of GRAM characters."""
    itself = evidence((np.arange(len(words)), np.arange(len(words) + 1)), held, labels) >= SIGN
    out = itself.copy()
    for size in LONGER:
        out |= evidence(runs(words, size), held, labels) >= SIGN
    left = np.array([not (y and itself[own].any()) for own, y in zip(held, labels, strict=True)])
    if (left & (labels == 1)).any():
        out |= evidence(runs(words, GRAM), [own for own, x in zip(held, left, strict=True) if x], labels[left]) >= SIGN
    return out


def train(texts: list[str], labels: np.ndarray, seed: int = 1) -> Model | None:
    """A model from labelled texts; None without both labels."""
    labels = np.asarray(labels)
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    rng = np.random.Generator(np.random.Philox(key=seed))
    model = Model(seed)
    places: dict[str, int] = {}
    tokens: dict[str, list[int]] = {}

    def numbers(text: str) -> np.ndarray:
        out: list[int] = []
        for t in text.split():
            if t not in tokens:
                tokens[t] = [places.setdefault(p, len(places)) for p in pieces(t)]
            out += tokens[t]
        return np.array(out, np.int32)

    read = [numbers(text) for text in texts]
    held = [np.unique(own).astype(np.int64) for own in read]
    words = list(places)
    if not words:
        return None
    clean = np.zeros(len(words), np.int64)
    for own, y in zip(held, labels, strict=True):
        clean[own] += y == 0
    blamed = signs(words, held, labels) & (clean == 0)
    fair = np.flatnonzero(clean > 0)
    hard = np.zeros(0, np.int64)
    for steps, rate in ((250, 0.02), (200, 0.01), (200, 0.005), (150, 0.002)):
        if not blamed.any() or not len(fair):
            break
        some = fair[rng.random(len(fair)) < SAMPLE_WORDS / len(fair)]
        # The clean words that the network finds most toxic so far come back often.
        pool = np.concatenate([some, np.repeat(hard, max(1, len(some) // max(1, 2 * len(hard)))) if len(hard) else hard])
        model.train_chars([words[i] for i in np.flatnonzero(blamed)], [words[i] for i in pool], steps, rate, rng)
        scores = model.word_scores(words)
        hard = fair[np.argsort(-scores[fair], kind="stable")[:HARD]]
    scores = model.word_scores(words)
    count = np.bincount(np.concatenate(held), minlength=len(words))
    model.vocabulary = {words[i]: 1 + n for n, i in enumerate(np.flatnonzero(count >= OWN))}
    model.embedding = np.zeros((1 + len(model.vocabulary), 4), np.float32)
    flat, counts = np.concatenate(read), np.array([len(own) for own in read])
    # A stretch of windows at a time: none of their tables covers the whole sample.
    owner = np.repeat(np.arange(len(counts)), np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1))
    best, signal = np.empty(len(owner), np.float32), np.empty(len(owner), bool)
    for lo in range(0, len(owner), 8192):
        codes, mask, _ = model.windows(flat, counts, slice(lo, lo + 8192))
        best[lo : lo + 8192] = np.where(mask > 0, scores[codes], -np.inf).max(axis=0)
        signal[lo : lo + 8192] = np.where(mask > 0, blamed[codes], False).any(axis=0)
    positive = (labels[owner] == 1) & (signal | (best > 3))
    negative = np.flatnonzero((labels[owner] == 0) & np.isfinite(best))
    negative = negative[np.argsort(-best[negative] + rng.random(len(negative)) * 8, kind="stable")][: max(3000, 3 * int(positive.sum()))]
    own = np.concatenate([np.flatnonzero(positive), negative])
    codes, mask, _ = model.windows(flat, counts, own)
    model.train_windows(words, codes, mask, positive[own].astype(np.float32), 12, 0.01, rng)
    # Calibration: a logistic fit of the documents' highest windows, at the sample's own mix of labels.
    x = model.logits(texts).astype(np.float64)
    model.blank = np.float32(np.median(x[labels == 0]))
    mean, spread = x.mean(), x.std() + 1e-9
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * (x - mean) / spread + b)))
        a -= float(((p - labels) * (x - mean) / spread).mean())
        b -= float((p - labels).mean())
    model.scale = np.array([max(a, 1e-3) / spread, b - max(a, 1e-3) * mean / spread])
    model.forget()
    model.rows = model.rows[:0]
    return model


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Train on a bounded sample of the labelled rows that aren't held out."""
    key = F.col(id_col).cast("string")
    own = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").cast("int").alias("y")).where((F.crc32(key.cast("binary")) % 5 != 0) & F.col("y").isin(0, 1))
    text = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.length("text") > 0)
    # Rows are chosen by id and hash alone; only the chosen ones' texts travel: 3 * sample rows of sample_chars characters, whatever the corpus.
    keyed = text.withColumn("th", F.xxhash64("text"))
    rows = own.join(keyed.select(id_col, "th"), id_col)
    chosen = [r for y, n in ((1, sample), (0, 2 * sample)) for r in rows.where(F.col("y") == y).orderBy(F.xxhash64(id_col, "th"), id_col, "th").limit(n).collect()]
    if not chosen:
        return None
    named = docs.sparkSession.createDataFrame([(r[id_col], r.th, r.y) for r in chosen], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, th long, y int").distinct()
    start = F.pmod(F.col("th"), F.greatest(F.length("text") - sample_chars + 1, F.lit(1))).cast("int") + 1
    stretch = F.substring("text", start, F.lit(sample_chars)).alias("text")
    found = keyed.join(F.broadcast(named), [id_col, "th"]).select(F.xxhash64(id_col, "th").alias("place"), "y", stretch).orderBy("place").limit(3 * sample).collect()
    return train([r.text for r in found], np.array([r.y for r in found]))


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for whole in batches:
            for batch in slices(whole, "__text", 2 << 20):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index("__text")).to_pylist()]
                scores = own.scores(texts) if own is not None else np.zeros(len(texts))
                keep = [i for i, c in enumerate(batch.schema.names) if c != "__text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=[*(batch.schema.names[i] for i in keep), "score", "predicted"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", "predicted")
