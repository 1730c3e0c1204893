"""Brown class-based bigram model: exchange clustering, transitions and emissions.

    P(w_i | w_(i-1)) = P(class_i | class_(i-1)) * P(w_i | class_i)

Words are given classes by the exchange algorithm (Kneser and Ney, 1993): a
word moves to the class that raises the likelihood of the class bigrams most.
As in distributed exchange clustering (Uszkoreit and Brants, 2008), a pass
counts the class contexts of every item over the whole corpus, in parallel, and
moves half of the items by exact gains against those counts; the best of all
passes is kept. Items are the `n_words` most frequent words, and all other
words by their ending, which move together (`n_endings` groups): so every word
has a class, also one never seen, and the model has a fixed size while its
counts cover all training tokens.

Two passes go over the texts: one counts words, one writes each text as item
numbers. Exchange passes read the item numbers alone. The `n_known` most
frequent words and their counts are known to every task; counts of all others
come by an equi-join on the word.

Cases: a null text is empty, its end alone; a null id is a training row;
repeated rows are scored and counted each; without training rows all counts are
zero; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import saved

# The end of a text; no word is empty.
END = b""
DELTA = 0.1
# Counts of a transition that the classes' own frequencies stand for.
PRIOR = 5.0
# Distinct words that a task counts before it sends them on.
COUNTED = 400_000
BLOCK = 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then the end."""
    words = (text or "").encode().translate(_LOWER).split()
    words.append(END)
    return words


def is_training(id_col: Column, parts: int = 10) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts != 0, F.lit(True))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def close() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
        )
        found.clear()
        return batch

    for batch in batches:
        for text in batch.column(0):
            found.update(tokens_of(text.as_py()))
            if len(found) >= COUNTED:
                yield close()
    if found:
        yield close()


def word_counts(texts: DataFrame) -> DataFrame:
    """`word` (bytes) and its count `n` over the column `text`."""
    return (
        texts.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(_count_words, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


@dataclass(frozen=True)
class Items:
    """Numbers of items: 0 is the end, then frequent words, then endings."""

    n_words: int
    n_endings: int

    @property
    def size(self) -> int:
        return 1 + self.n_words + self.n_endings

    def of_ending(self, word: bytes) -> int:
        return 1 + self.n_words + crc32(word[-3:]) % self.n_endings

    def of_rank(self, words: list[bytes]) -> np.ndarray:
        """The item of each of the known words, which are sorted by frequency."""
        out, next_ = np.empty(len(words), np.int16), 1
        for i, w in enumerate(words):
            if w == END:
                out[i] = 0
            elif next_ <= self.n_words:
                out[i], next_ = next_, next_ + 1
            else:
                out[i] = self.of_ending(w)
        return out


@dataclass
class Known:
    """The most frequent words with their counts."""

    words: list[bytes]
    counts: np.ndarray
    items: np.ndarray

    def __post_init__(self) -> None:
        self.rank = {w: i for i, w in enumerate(self.words)}


def frequency_bin(n: Column) -> Column:
    return F.floor(16 * F.log2(n)).cast("int")


def _known_words(vocabulary: DataFrame, n_known: int, items: Items) -> Known:
    """At most `n_known` words: all that are more frequent than a bound on the count.

    The bound comes from a histogram of some hundred bins, so that no task sends
    more than its share of these words to the driver.
    """
    bins = vocabulary.groupBy(frequency_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("words"))
    held, least = 0, 0
    for r in sorted(bins.collect(), reverse=True):
        held += r.words
        if held > n_known:
            least = r.bin + 1
            break
    top = vocabulary.filter(frequency_bin(F.col("n")) >= least).toArrow()
    found = sorted(zip(top["n"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    words = [w for _, w in found]
    return Known(words, np.array([n for n, _ in found], np.int64), items.of_rank(words))


def _item_sizes(known, items: Items):
    """Distinct words and tokens of each item, from a vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Known = known.value
        distinct, total = np.zeros((2, items.size), np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            number = np.array(
                [own.items[r] if (r := own.rank.get(w, -1)) >= 0 else items.of_ending(w) for w in words],
                np.int64,
            )
            distinct += np.bincount(number, minlength=items.size)
            np.add.at(total, number, np.asarray(batch.column(1)))
        used = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(distinct[used]), pa.array(total[used])], ["item", "distinct", "total"]
        )

    return run


_CODED = (
    "row long, doc_id long, training boolean, n_tokens long, n_known long, log_count double, "
    "items binary, rare array<struct<word: binary, n: int>>"
)
_RARE = pa.struct([("word", pa.binary()), ("n", pa.int32())])


def _encode(known, items: Items):
    """Texts as item numbers; words that are not known are listed with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Known = known.value
        counts = np.append(own.counts, 0)
        logs = np.log10(counts + DELTA)
        item_of = np.append(own.items, -1).astype(np.int16)
        row = TaskContext.get().partitionId() << 33
        get = own.rank.get
        for batch in batches:
            n = batch.num_rows
            columns: list[list] = [[], [], [], []]
            words, numbers, offsets = [], [], [0]
            for text in batch.column(2):
                tokens = tokens_of(text.as_py())
                # Words that are not known have rank -1, which is the last place.
                rank = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                item = item_of[rank]
                unknown = np.flatnonzero(rank < 0)
                log = logs[rank].sum()
                if len(unknown):
                    rare = Counter([tokens[i] for i in unknown.tolist()])
                    number = {w: items.of_ending(w) for w in rare}
                    item[unknown] = [number[tokens[i]] for i in unknown.tolist()]
                    words += rare
                    numbers += rare.values()
                offsets.append(len(words))
                for column, value in zip(
                    columns, (len(tokens), int((counts[rank] > 0).sum()), log, item.tobytes()), strict=True
                ):
                    column.append(value)
            flat = pa.StructArray.from_arrays(
                [pa.array(words, pa.binary()), pa.array(numbers, pa.int32())], fields=list(_RARE)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    batch.column(0),
                    batch.column(1),
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.float64()),
                    pa.array(columns[3], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                ],
                ["row", "doc_id", "training", "n_tokens", "n_known", "log_count", "items", "rare"],
            )
            row += n

    return run


def _pairs(items: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Items before and items after, over some texts at a time; the end stands before each text."""
    for a in range(0, len(items), 512):
        after = np.frombuffer(b"".join(items[a : a + 512].to_pylist()), np.int16).astype(np.int64)
        # Each text ends with item 0, which thus also stands before the next.
        yield np.concatenate([[0], after[:-1]]) if len(after) else after, after


def _count_contexts(classes: np.ndarray, n_classes: int):
    """By blocks of items: how often each class follows and precedes, and the item itself."""
    size = len(classes)
    padded = -(-size // BLOCK) * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follows, precedes = np.zeros((2, padded * n_classes), np.int64)
        itself = np.zeros(padded, np.int64)
        for batch in batches:
            for before, after in _pairs(batch.column(0)):
                follows += np.bincount(before * n_classes + classes[after], minlength=len(follows))
                precedes += np.bincount(after * n_classes + classes[before], minlength=len(follows))
                itself += np.bincount(after[after == before], minlength=padded)
        rows = {"block": [], "data": []}
        for b in range(0, padded, BLOCK):
            part = slice(b * n_classes, (b + BLOCK) * n_classes)
            data = np.concatenate([follows[part], precedes[part], itself[b : b + BLOCK]])
            rows["block"].append(b // BLOCK)
            # Most counts of one task are small.
            rows["data"].append(data.astype("<u4" if data.max() < 1 << 32 else "<u8").tobytes())
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("block", pa.int64()), ("data", pa.binary())]))

    return run


def _add_blocks(n_classes: int):
    cells = BLOCK * (2 * n_classes + 1)

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(cells, np.int64)
        for data in table.column("data").to_pylist():
            total += np.frombuffer(data, "<u4" if len(data) == 4 * cells else "<u8").astype(np.int64)
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    return run


def contexts(coded: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, ...]:
    """Counts over all training texts: (item, class after), (class before), (item itself)."""
    partial = coded.filter("training").select("items").mapInArrow(
        _count_contexts(classes, n_classes), "block long, data binary"
    )
    # One row for each block of items: a table of the model's size.
    rows = partial.groupBy("block").applyInArrow(_add_blocks(n_classes), "block long, data binary").collect()
    padded = -(-len(classes) // BLOCK) * BLOCK
    follows, precedes = np.zeros((2, padded, n_classes), np.int64)
    itself = np.zeros(padded, np.int64)
    for r in rows:
        data = np.frombuffer(r.data, np.int64)
        part = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
        cut = BLOCK * n_classes
        follows[part] = data[:cut].reshape(BLOCK, n_classes)
        precedes[part] = data[cut : 2 * cut].reshape(BLOCK, n_classes)
        itself[part] = data[2 * cut :]
    n = len(classes)
    return follows[:n], precedes[:n], itself[:n]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def class_bigrams(follows: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    out = np.zeros((n_classes, n_classes))
    np.add.at(out, classes, follows)
    return out


def likelihood(bigrams: np.ndarray) -> float:
    """Log likelihood of the classes, but for what does not depend on them."""
    return float(
        _xlogx(bigrams).sum() - _xlogx(bigrams.sum(axis=1)).sum() - _xlogx(bigrams.sum(axis=0)).sum()
    )


def exchange(
    classes: np.ndarray,
    follows: np.ndarray,
    precedes: np.ndarray,
    itself: np.ndarray,
    movable: np.ndarray,
    n_classes: int,
) -> np.ndarray:
    """Move each movable item to its best class; exact for the given contexts."""
    classes = classes.copy()
    counts = class_bigrams(follows, classes, n_classes)
    for item in movable.tolist():
        own, after, before, twice = classes[item], follows[item], precedes[item], itself[item]
        n = after.sum()
        if n == 0:
            continue
        rest = counts.copy()
        rest[own] -= after
        rest[:, own] -= before
        rest[own, own] += twice
        rest = np.maximum(rest, 0.0)
        after, before = after.astype(float), before.astype(float)
        after[own], before[own] = max(after[own] - twice, 0), max(before[own] - twice, 0)
        base, corner = _xlogx(rest), np.diagonal(rest)
        corner_base = _xlogx(corner)
        total = rest.sum(axis=1)
        gain = (
            (_xlogx(rest + after) - base).sum(axis=1)
            + (_xlogx(rest + before[:, None]) - base).sum(axis=0)
            - _xlogx(corner + after)
            - _xlogx(corner + before)
            + _xlogx(corner + after + before + twice)
            + corner_base
            - 2 * (_xlogx(total + n) - _xlogx(total))
        )
        gain[0] = -np.inf  # the class of the end
        best = int(np.argmax(gain))
        if gain[best] > gain[own] + 1e-9:
            counts = rest
            counts[best] += after
            counts[:, best] += before
            counts[best, best] += twice
            classes[item] = best
    return classes


def cluster(coded: DataFrame, items: Items, n_classes: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all items, and the class bigrams of the training texts."""
    classes = np.minimum(np.arange(items.size), n_classes - 1)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    order = np.arange(1, items.size)
    for turn in range(passes + 1):
        counted = contexts(coded, classes, n_classes)
        bigrams = class_bigrams(counted[0], classes, n_classes)
        value = likelihood(bigrams)
        if best is None or value > best[0]:
            best = value, classes, bigrams
        if turn < passes:
            # At first all leave the common class; then the halves take turns.
            movable = order if turn == 0 else order[order % 2 == turn % 2]
            classes = exchange(classes, *counted, movable, n_classes)
    return best[1], best[2]


@dataclass
class Tables:
    classes: np.ndarray
    transitions: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of the denominators of emissions


def _tables(classes: np.ndarray, bigrams: np.ndarray, distinct: np.ndarray, total: np.ndarray) -> Tables:
    n = len(bigrams)
    share = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + n)
    rows = bigrams.sum(axis=1, keepdims=True)
    transitions = np.log10((bigrams + PRIOR * share) / (rows + PRIOR))
    words = np.bincount(classes, weights=distinct, minlength=n)
    tokens = np.bincount(classes, weights=total, minlength=n)
    return Tables(classes, transitions, np.log10(tokens + DELTA * (words + 1)))


def _class_part(tables: Tables):
    """Of each text: log10 of its transitions over the emissions' denominators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                item = tables.classes[np.frombuffer(data, np.int16)]
                before = np.concatenate([[tables.classes[0]], item[:-1]])
                out.append(float(tables.transitions[before, item].sum() - tables.room[item].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["row", "class_log"])

    return run


def class_model_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    n_classes: int = 64,
    n_words: int = 4096,
    n_endings: int = 1024,
    n_known: int = 200_000,
    passes: int = 5,
) -> DataFrame:
    """Unigram and class-bigram log10 probabilities of every row of `docs`.

    Rows whose crc32 of the id is divisible by ten are held out of all counts.
    """
    spark = docs.sparkSession
    items = Items(n_words, n_endings)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        is_training(F.col(id_col)).alias("training"),
        F.col("text").cast("string").alias("text"),
    )
    vocabulary = saved(word_counts(rows.filter("training")), "words")
    n_tokens, n_distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known = _known_words(vocabulary, n_known, items)
    shared = spark.sparkContext.broadcast(known)  # at most n_known words
    sizes = (
        vocabulary.mapInArrow(_item_sizes(shared, items), "item long, distinct long, total long")
        .groupBy("item")
        .agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total"))
        .collect()
    )
    distinct, total = np.zeros((2, items.size))
    for r in sizes:
        distinct[r.item], total[r.item] = r.distinct, r.total
    coded = saved(rows.mapInArrow(_encode(shared, items), _CODED), "coded")
    classes, bigrams = cluster(coded, items, n_classes, passes)
    tables = _tables(classes, bigrams, distinct, total)
    # A word without a count has log10(DELTA) already; those that have one add the rest.
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    lift = F.log10(F.col("n") + DELTA) - F.log10(F.lit(DELTA))
    found = (
        rare.join(vocabulary, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * lift).alias("rare_log"))
    )
    parts = coded.select("row", "items").mapInArrow(_class_part(tables), "row long, class_log double")
    whole = float(np.log10(n_tokens + DELTA * (n_distinct + 1)))
    logs = F.col("log_count") + F.coalesce("rare_log", F.lit(0.0))
    return (
        coded.select("row", "doc_id", "training", "n_tokens", "n_known", "log_count")
        .join(parts, "row")
        .join(found, "row", "left")
        .select(
            F.col("doc_id").alias(id_col),
            (~F.col("training")).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(n_tokens).cast("long").alias("train_tokens"),
            (logs - F.col("n_tokens") * whole).alias("base_score"),
            (logs + F.col("class_log")).alias("score"),
        )
    )
