"""Toxicity by a subsequence string kernel and a linear support vector machine.

Words are compared by the gap-weighted subsequence kernel (Lodhi et al., 2002):
two words are similar if they share subsequences of three letters, and a gap
costs a factor `DECAY` for each letter it spans. An insult with letters put in
or left out thus stays close to itself. Landmarks are words of labelled training
texts and beginnings of them; the Nystroem map K_mm^(-1/2) turns similarities to
them into features. A text is a bag of words. For each landmark its best word
counts, wherever in the text it stands, and the sum of similarities by a hundred
words. A linear support vector machine is trained on the features and a sigmoid
on its margins gives the score.

Words are runs between white space, in lower case and without what is not a
letter, so that `i.d-i_o7t` is read as it sounds; neighbouring single letters
are put together. Of longer words than REACH letters all parts of that length
count that begin at every half of it.

The training sample is bounded: at most `per_class` labelled texts of each
class, those with the least hash of their id. Everything else covers all texts.
Similarities below FLOOR count as zero, and are skipped where a bound shows it:
a word without some of a landmark's letters can reach no more than the weight
of the landmark's subsequences that need none of them.

Cases: null and blank texts have no words and get the score of no match; null
labels are not used, and of several labels of an id the largest counts; without
labelled rows of both classes every score is the share of toxic ones among them;
repeated rows are scored each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DECAY, FLOOR, REACH = 0.6, 0.45, 20
LENGTH = 3
# Letters of the beginnings of words that may be landmarks.
BEGINNINGS = (4, 5, 6, 7)
# Rows whose new words are compared together, and words remembered by a worker.
ROWS, REMEMBERED = 2_000, 1_000_000

_NO_LETTER = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S))+")


def words_of(text: str) -> set[str]:
    """Distinct words of a text, as written but in lower case."""
    low = text.lower()
    words = set(low.split())
    if any(len(w) == 1 for w in words):
        words.update("".join(run.split()) for run in _SPACED.findall(low))
    return words


def letters_of(word: str) -> list[str]:
    """The parts of a word that are compared."""
    plain = _NO_LETTER.sub("", word)
    if len(plain) <= REACH:
        return [plain] if len(plain) >= LENGTH else []
    half = REACH // 2
    return [plain[a : a + REACH] for a in range(0, len(plain) - half, half)]


def _codes(words: list[str]) -> np.ndarray:
    return np.array(words, f"<U{REACH}").view("<u4").reshape(len(words), REACH)


def subsequence_kernel(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Kernel of each row of `words` with the same row of `other` (codes, 0 after the end).

    `other` may be one row for all. The recursion runs over letter positions;
    all rows are done together.
    """
    n = len(words)
    width = int(np.count_nonzero(words, axis=1).max(initial=0))
    reach = int(np.count_nonzero(other, axis=1).max(initial=0))
    square = DECAY * DECAY
    # before[i][j]: weighted matches of i letters within the prefixes, spans to the end counted.
    before = np.zeros((LENGTH, reach + 1, n), np.float32)
    before[0] = 1
    total = np.zeros(n, np.float32)
    for a in range(width):
        letter = words[:, a]
        equal = [
            ((letter == other[:, j]) & (letter != 0)).astype(np.float32) * np.float32(square)
            for j in range(reach)
        ]
        for j in range(reach):
            total += equal[j] * before[LENGTH - 1][j]
        for i in range(LENGTH - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(reach):
                run = DECAY * run + equal[j] * before[i - 1][j]
                before[i][j + 1] = DECAY * before[i][j + 1] + run
    return total


def _letter_bits(codes: np.ndarray) -> np.ndarray:
    bits = np.where(codes > 0, np.uint64(1) << (codes % 64).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def _own_weights(word: str) -> dict[str, float]:
    """Weight of each subsequence of LENGTH letters of a short word."""
    found: dict[str, float] = {}
    n = len(word)
    for a in range(n):
        for b in range(a + 1, n):
            for c in range(b + 1, n):
                key = word[a] + word[b] + word[c]
                found[key] = found.get(key, 0.0) + DECAY ** (c - a + 1)
    return found


@dataclass
class Landmark:
    """A landmark word, and by the set of its letters present how similar a word can be."""

    word: str
    bits: list[int] = field(default_factory=list)
    bound: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.bits = sorted({ord(c) % 64 for c in self.word})
        weights = _own_weights(self.word)
        needs = [
            (sum(1 << self.bits.index(b) for b in {ord(c) % 64 for c in key}), w * w)
            for key, w in weights.items()
        ]
        whole = sum(w for _, w in needs)
        masks = np.arange(1 << len(self.bits))
        share = np.zeros(len(masks))
        for need, w in needs:
            share += np.where(masks & need == need, w, 0.0)
        self.bound = np.sqrt(share / whole)

    def at_most(self, letter_bits: np.ndarray) -> np.ndarray:
        index = np.zeros(len(letter_bits), np.int64)
        for i, b in enumerate(self.bits):
            index |= (letter_bits >> np.uint64(b) & np.uint64(1)).astype(np.int64) << i
        return self.bound[index]


def similarities(words: list[str], landmarks: list[Landmark]) -> tuple[np.ndarray, ...]:
    """(word number, landmark number, normalized kernel) wherever it is above FLOOR."""
    none = np.zeros(0, np.int64)
    if not words:
        return none, none, none.astype(np.float32)
    codes = _codes(words)
    bits = _letter_bits(codes)
    pairs = [np.flatnonzero(mark.at_most(bits) > FLOOR) for mark in landmarks]
    needed = np.unique(np.concatenate(pairs)) if pairs else none
    norm = np.zeros(len(words), np.float32)
    for a in range(0, len(needed), 20_000):
        part = needed[a : a + 20_000]
        norm[part] = subsequence_kernel(codes[part], codes[part])
    which, number, value = [none], [none], [np.zeros(0, np.float32)]
    for j, (mark, rows) in enumerate(zip(landmarks, pairs, strict=True)):
        other = _codes([mark.word])
        own = subsequence_kernel(other, other)[0]
        for a in range(0, len(rows), 20_000):
            part = rows[a : a + 20_000]
            k = subsequence_kernel(codes[part], other) / np.sqrt(np.maximum(norm[part] * own, 1e-12))
            near = k > FLOOR
            which.append(part[near])
            number.append(np.full(int(near.sum()), j))
            value.append(k[near])
    return np.concatenate(which), np.concatenate(number), np.concatenate(value)


class Matcher:
    """Best similarity of texts to each landmark; remembers words that it has compared."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = [Landmark(w) for w in landmarks]
        self.known: dict[str, tuple | None] = {}

    def learn(self, words: list[str]) -> None:
        parts_of = {w: letters_of(w) for w in words}
        parts = list({p for parts in parts_of.values() for p in parts})
        near: dict[str, dict[int, float]] = {}
        for i, j, k in zip(*(x.tolist() for x in similarities(parts, self.landmarks)), strict=True):
            near.setdefault(parts[i], {})[j] = (k - FLOOR) / (1 - FLOOR)
        for w, own in parts_of.items():
            best: dict[int, float] = {}
            for part in own:
                for j, k in near.get(part, {}).items():
                    best[j] = max(best.get(j, 0.0), k)
            found = np.array(list(best)), np.array(list(best.values()), np.float32)
            self.known[w] = found if best else None

    def features(self, texts: list[str | None]) -> np.ndarray:
        n = len(self.landmarks)
        best, mass = np.zeros((2, len(texts), n), np.float32)
        hundreds = np.ones((len(texts), 1), np.float32)
        for a in range(0, len(texts), ROWS):
            bags = [words_of(t) if t else set() for t in texts[a : a + ROWS]]
            everything = set().union(*bags)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn([w for w in everything if w not in self.known])
            for i, bag in enumerate(bags, a):
                hundreds[i] += len(bag) / 100
                for w in bag:
                    match = self.known[w]
                    if match is not None:
                        numbers, values = match
                        best[i, numbers] = np.maximum(best[i, numbers], values)
                        mass[i, numbers] += values
        return np.hstack([best, mass / hundreds])


@dataclass
class Model:
    landmarks: list[str]
    # Weights on best similarities: the Nystroem map times the machine's weights.
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def is_training(id_col: Column, parts: int = 5) -> Column:
    return F.crc32(id_col.cast("string")) % parts != 0


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """At most 2 * per_class labelled training texts (doc_id, text, y)."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(is_training(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("y"))
    )
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by per_class
    return docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ys = [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bag = {p for w in words_of(text or "") for p in letters_of(w)}
            bag |= {p[:n] for p in bag for n in BEGINNINGS if n < len(p)}
            words += bag
            ys += [y] * len(bag)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ys, pa.int32())], ["word", "y"])


def _choose_landmarks(sample: DataFrame, n: int, candidates: int = 600) -> list[str]:
    """Words that set toxic texts apart, none of them close to one chosen before."""
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return []
    by_word = (
        sample.select("text", "y")
        .mapInArrow(_word_rows, "word string, y int")
        .groupBy("word")
        .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
        .filter(F.col("t") >= 3)
    )
    odds = F.log((F.col("t") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("c") + 0.5) / (totals[0] + 1.0))
    score = F.round(odds * F.sqrt("t"), 9)
    top = by_word.withColumn("score", score).filter("score > 0")
    words = [r.word for r in top.orderBy(F.desc("score"), "word").limit(candidates).collect()]
    chosen: list[str] = []
    for w in words:
        if len(chosen) < n and (
            not chosen or similarities([w], [Landmark(c) for c in chosen])[2].max(initial=0) < 0.75
        ):
            chosen.append(w)
    return chosen


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate ascent; classes weigh the same."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    sign = np.where(y > 0, 1.0, -1.0)
    most = cost * np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    alpha, w = np.zeros(len(y)), np.zeros(x1.shape[1])
    square = (x1 * x1).sum(axis=1)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (sign[i] * (x1[i] @ w) - 1) / square[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x1[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's sigmoid, by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.array([1.0, 0.0])
    design = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (p - target) + 1e-3 * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(curve, slope)
    return float(beta[0]), float(beta[1])


def _featurize(landmarks: list[str], finish):
    """mapInArrow function over (doc_id, text, more columns...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(tuple(landmarks))
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                yield finish(batch, matcher.features(batch.column(1).to_pylist()))

    return run


_matchers: dict[tuple[str, ...], Matcher] = {}


def _matcher(landmarks: tuple[str, ...]) -> Matcher:
    """One for each worker process and model."""
    if landmarks not in _matchers:
        _matchers.clear()
        _matchers[landmarks] = Matcher(list(landmarks))
    return _matchers[landmarks]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, n_landmarks: int = 80) -> Model:
    sample = _sample(docs, labels, per_class)
    landmarks = _choose_landmarks(sample, n_landmarks)

    def with_y(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        rows = pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), rows], ["y", "doc_id", "x"])

    found = (
        sample.select("doc_id", "text", "y")
        .mapInArrow(_featurize(landmarks, with_y), "y int, doc_id long, x array<float>")
        .collect()  # bounded by per_class and n_landmarks
    )
    y = np.array([r.y for r in found])
    if not landmarks or len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
        return Model([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    found.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in found])
    x = np.array([r.x for r in found], np.float64)
    marks = [Landmark(w) for w in landmarks]
    own = np.eye(len(landmarks))
    i, j, k = similarities(landmarks, marks)
    own[i, j] = np.maximum(k - FLOOR, 0) / (1 - FLOOR)
    own = (own + own.T) / 2
    values, vectors = np.linalg.eigh(own)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    n = len(landmarks)
    mapped = np.hstack([x[:, :n] @ root, x[:, n:] @ root])
    weights, bias = train_machine(mapped, y)
    slope, shift = _sigmoid_fit(mapped @ weights + bias, y)
    return Model(landmarks, np.r_[root @ weights[:n], root @ weights[n:]], bias, slope, shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def finish(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        values = model.scores(x.astype(np.float64)) if len(x) else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(values, pa.float64()),
                pa.array((values >= 0.5).astype(np.int32), pa.int32()),
            ],
            ["doc_id", "score", "predicted"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_featurize(model.landmarks, finish), "doc_id long, score double, predicted int")
    held_out = F.coalesce(~is_training(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
