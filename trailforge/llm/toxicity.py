"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, of toxic and of ordinary text, give each word a log-likelihood
ratio.  They differ in the counts of their highest order alone (a letter after
the five before it, within a word); below, both back off to the same
continuation counts, so a stretch that neither class has shown weighs nothing,
and a rare form of an insult is known by the part it shares with others.

All labelled rows that may be learned from are counted, gram by gram, and the
counts grow with them and none is pruned.  Up to ``MOST_GRAMS`` distinct grams of
the highest order are broadcast; with more, tables of all grams are joined with
those of the documents' distinct words, and blocks of documents get the ratios of
their own words, which gives the same scores.  Grams are found by their
64-bit hashes (of ten million grams, two share one with a chance of 3 in a
million).  Ratios are normalised by length over the whole text and over its
windows of words; a logistic curve over both, fitted on a bounded sample of
labelled rows scored by a model of the *other* half of the rows, makes them a
probability.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, resident, row_slices, whole_text, with_columns
from .stretches import Remembered, stretches, utf8

ORDER = 6
DISCOUNT = 0.75
#: Discounts of a class's counts of one, two and more; those of the shared counts are all the last.
SINGLE, DOUBLE = 0.9, 0.82
#: Words of the windows, and how many of the highest words are averaged.
SPANS, HIGHEST = (6, 12), (1, 3, 5)
#: Labelled ids that the curve is fitted on, about, half of each class where there are enough; of an id's rows one is taken.
FITTED_ON = 20_000
#: Distinct grams of the highest order that are broadcast; with more, all are joined with the grams of the documents' words.
MOST_GRAMS = 4_000_000
#: Grams that a task gathers before it hands them on.
HELD_GRAMS = 500_000
THRESHOLD = 0.3
#: A letter that no count knows has this probability.
FLOOR = 1.0 / 4096
#: Ratios of a word are cut to this, so that no single word speaks for a text of any length.
MOST = 12.0

_WORDS = re.compile(r"[^\W\d_]+").findall
_C = np.uint64(0x9E3779B97F4A7C15)
_BLANK, _END = "\x02", "\x03"


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _longer(key: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """The hash of ``n + 1`` letters from that of the last ``n`` and the letter before them."""
    return _mix(key + _mix((before + np.uint64(77 * n + 1)) * _C))


def hashes(words: list[str], grams: bool = False) -> tuple[list[np.ndarray], list[np.ndarray] | np.ndarray, np.ndarray]:
    """For each letter of each word and its end: hashes of the 1 ... ``ORDER`` letters that end there, of the 0 ... ``ORDER - 1`` before it (or the ``ORDER`` letters themselves), and its word."""
    pad = _BLANK * (ORDER - 1)
    flat = np.frombuffer((pad + (_END + pad).join(words) + _END).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + ORDER)
    at = np.flatnonzero(flat != ord(_BLANK))
    keys = [_mix((flat + np.uint64(1)) * _C)]
    for n in range(1, ORDER):
        longer = np.zeros_like(flat)
        longer[n:] = _longer(keys[-1][n:], flat[:-n], n)
        keys.append(longer)
    if grams:
        letters = np.lib.stride_tricks.sliding_window_view(flat.astype("<u4"), ORDER)[at - ORDER + 1]
        return [k[at] for k in keys], np.ascontiguousarray(letters).view(f"<U{ORDER}")[:, 0], of[at]
    return [k[at] for k in keys], [np.zeros(len(at), np.uint64), *(k[at - 1] for k in keys[:-1])], of[at]


def gram_hashes(grams: list[str]) -> np.ndarray:
    """Hashes of texts of one length, as ``hashes`` makes them."""
    n = len(grams[0])
    if not n:
        return np.zeros(len(grams), np.uint64)
    m = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, n)
    key = _mix((m[:, -1] + np.uint64(1)) * _C)
    for i in range(1, n):
        key = _longer(key, m[:, n - 1 - i], i)
    return key


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


class Index:
    """Rows of distinct 64-bit keys by open addressing, with at most half of the slots filled."""

    def __init__(self, keys: np.ndarray) -> None:
        self.n, bits = len(keys), max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.append(keys, np.uint64(0))
        self.slots = np.full(1 << bits, self.n, np.int32)
        left, at = np.arange(self.n, dtype=np.int32), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[at] == self.n
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; ``n`` for an unknown one."""
        at = (keys >> self.shift).astype(np.int64)
        found = self.slots[at]
        todo = np.flatnonzero((found != self.n) & (self.keys[found] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.slots[at[todo]]
            found[todo] = got
            todo = todo[(got != self.n) & (self.keys[got] != keys[todo])]
        return found


def letter_ratio(total: float, kinds: float, below: list[np.ndarray], before: list[tuple[np.ndarray, np.ndarray]], sides: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Log-likelihood ratios of letters, each after the ones before it.

    ``below``: continuation counts of the grams of 1 ... ``ORDER - 1`` letters;
    ``before``: sums and kinds of the histories of 1 ... ``ORDER - 2`` letters;
    ``sides``: for toxic and ordinary text, the count of the whole gram, and sum
    and kinds of its history.
    """
    p = np.full(len(below[0]), FLOOR)
    totals, kind = np.full(len(p), total), np.full(len(p), kinds)
    for c, after in zip(below, [*before, None], strict=True):
        t = np.maximum(totals, 1)
        p = np.where(totals > 0, np.maximum(c - DISCOUNT, 0) / t + DISCOUNT * kind / t * p, p)
        if after:
            totals, kind = after[0].astype(float), after[1]
    ratio = np.zeros(len(p))
    for sign, (c, n, k) in zip((1, -1), sides, strict=True):
        c, n = c.astype(float), n.astype(float)
        t = np.maximum(n, 1)
        less = np.where(c <= 1, SINGLE, np.where(c <= 2, DOUBLE, DISCOUNT))
        ratio += sign * np.log(np.where(n > 0, np.maximum(c - less, 0) / t + SINGLE * k / t * p, p))
    return ratio


class Ratio:
    """Log-likelihood ratios of words and texts, from counts.

    ``counts``: for each order below the highest, keys of grams with their
    continuation counts and, as histories, the sums and kinds of what follows
    (for the last of these orders, sums and kinds by class); for the highest,
    keys with whole counts by class.
    """

    def __init__(self, counts: list[dict[str, np.ndarray]]) -> None:
        self.levels = [(Index(level["key"]), {k: np.append(v, 0).astype(np.float32) for k, v in level.items() if k != "key"}) for level in counts[1:]]
        self.total, self.kinds = (float(counts[0][x]) for x in "nk")
        self._remembered = Remembered(self._make, kind=np.float64)

    def words(self, words: list[str]) -> np.ndarray:
        """The ratio of each word, summed over its letters and cut to ``MOST``."""
        keys, before, of = hashes(words)
        below, before_it = [], []
        for n in range(1, ORDER):
            index, table = self.levels[n - 1]
            below.append(table["c"][index(keys[n - 1])])
            history = index(before[n])
            if n < ORDER - 1:
                before_it.append((table["n"][history], table["k"][history]))
        index, top = self.levels[-1]
        row = index(keys[-1])
        ratio = letter_ratio(self.total, self.kinds, below, before_it, [(top[x][row], table["n" + x][history], table["k" + x][history]) for x in "to"])
        return np.clip(np.bincount(of, ratio, len(words)), -MOST, MOST)

    def _make(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [words_of(x.decode("utf-8", "surrogatepass")) for x in new]
        words = list(chain.from_iterable(found))
        parts = [self.words(words[at : at + 5_000]) for at in range(0, len(words), 5_000)]
        return np.concatenate(parts or [np.zeros(0)]), np.fromiter(map(len, found), np.int64, len(found))

    def texts(self, texts: pa.Array) -> np.ndarray:
        """``FEATURES`` of every whole text (null: empty), a row each; all 0 without words."""
        parts, first = stretches(*utf8(texts))
        r, size = self._remembered(parts)
        bounds = np.concatenate([[0], np.cumsum(size)])[first]
        n = np.diff(bounds)
        out = np.zeros((len(n), len(FEATURES)))
        some = np.flatnonzero(n)
        if not len(some):
            return out
        a, n = bounds[:-1][some], n[some]
        b, of = a + n, np.repeat(np.arange(len(some)), n)
        sums, above = (np.concatenate([[0.0], np.cumsum(x)]) for x in (r, np.maximum(r, 0)))
        made = [(sums[b] - sums[a]) / n, (above[b] - above[a]) / n]
        for span in SPANS:
            window = np.full(len(r), -np.inf)
            if len(r) > span:
                window[: len(r) - span + 1] = sums[span:] - sums[:-span]
            window[np.arange(len(r)) > np.repeat(b - span, n)] = -np.inf
            best = np.maximum.reduceat(window, a)
            made.append(np.where(n > span, best, sums[b] - sums[a]) / span)
        high = np.concatenate([[0.0], np.cumsum(r[np.lexsort((-r, of))])])
        made += [(high[a + np.minimum(n, k)] - high[a]) / k for k in HIGHEST]
        out[some] = np.round(np.column_stack([*made, np.log1p(n)]), 9)  # the same in whatever batch a text lies
        return out


class Looked(Ratio):
    """The same from ratios of words that are known already."""

    def __init__(self, known: dict[str, float]) -> None:
        self.known = known
        self._remembered = Remembered(self._make, kind=np.float64)

    def words(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))


#: Ratios per word over the text, and of those above 0; the highest over windows; the mean of the highest words; log of the length.
FEATURES = ("mean", "above", *(f"span{n}" for n in SPANS), *(f"high{n}" for n in HIGHEST), "size")

#: Counts of toxic and ordinary texts, by fold.
COUNTS = ("t0", "o0", "t1", "o1")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of ``ORDER`` in the words of labelled texts, with counts by class and fold; each slice of texts is counted on its own."""
    key, gram, count = np.zeros(0, np.uint64), np.zeros(0, f"<U{ORDER}"), np.zeros((0, 4), np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, at, back = np.unique(key, return_index=True, return_inverse=True)
        return own, gram[at], np.column_stack([np.bincount(back, count[:, j], len(own)).astype(np.int64) for j in range(4)])

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(gram), *(pa.array(count[:, j]) for j in range(4))], names=["gram", *COUNTS])

    for batch in row_slices(batches):
        parts, first = stretches(*utf8(batch["text"]))
        side = np.repeat(batch["side"].to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first))
        every = np.bincount(parts.indices.to_numpy() * 4 + side, minlength=4 * len(parts.dictionary)).reshape(-1, 4)
        found = [words_of(x.decode("utf-8", "surrogatepass")) for x in parts.dictionary.to_pylist()]
        words, own = list(chain.from_iterable(found)), np.repeat(every, np.fromiter(map(len, found), np.int64, len(found)), axis=0)
        for at in range(0, len(words), 20_000):
            keys, letters, of = hashes(words[at : at + 20_000], True)
            key, gram, count = np.concatenate([key, keys[-1]]), np.concatenate([gram, letters]), np.concatenate([count, own[at : at + 20_000][of]])
            key, gram, count = merged()
        if len(key) > HELD_GRAMS:
            yield handed()
            key, gram, count = key[:0], gram[:0], count[:0]
    if len(key):
        yield handed()


_SUMS = ("c", "n", "k", "nt0", "no0", "nt1", "no1", "kt0", "ko0", "kt1", "ko1", "kt", "ko")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What distinct grams add to the rows of their own key and of their history's; the highest order has counts instead of a row of its own."""
    for batch in batches:
        size, grams = batch["size"].to_numpy(), batch["gram"].to_pylist()
        counts = np.column_stack([batch[x].to_numpy() for x in COUNTS])
        out = []
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            own = [grams[i] for i in at.tolist()]
            c = counts[at]
            history = np.zeros((len(at), len(_SUMS)), np.int64)
            if n == ORDER:
                history[:, 3:7], history[:, 7:11] = c, c > 0
                history[:, 11], history[:, 12] = c[:, 0] + c[:, 2] > 0, c[:, 1] + c[:, 3] > 0
            else:
                history[:, 1], history[:, 2] = c[:, 0], 1
                row = np.zeros_like(history)
                row[:, 0] = c[:, 0]
                out.append((np.full(len(at), n), gram_hashes(own), row))
            out.append((np.full(len(at), n - 1), gram_hashes([g[:-1] for g in own]), history))
        size, key, sums = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(key.view(np.int64)), *(pa.array(sums[:, j]) for j in range(len(_SUMS)))], names=["size", "key", *_SUMS])


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key = gram_hashes(batch["gram"].to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(batch[x] for x in COUNTS)], names=["key", *COUNTS])


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with a label that may be learned from; ``side``: 0 toxic, 1 ordinary, 2 more for the second fold."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    side = F.when(F.col("toxic") == 1, 0).otherwise(1) + fold * 2
    return docs.join(labels, "doc_id").select("doc_id", "text", side.cast("int").alias("side"))


def _kept(grams: DataFrame) -> DataFrame:
    """All grams, or those of the least count that leaves ``MOST_GRAMS`` at most; no score is made from these."""
    total = sum(map(F.col, COUNTS))
    # how many grams have each count, counts of 1,000 and more together
    of = sorted(((r.c, r.n) for r in grams.groupBy(F.least(total, F.lit(1000)).alias("c")).agg(F.count("*").alias("n")).collect()), reverse=True)
    left, least = MOST_GRAMS, 1
    for c, n in of:
        left -= n
        if left < 0:
            least = c + 1
            break
    return grams.where(total >= least) if least > 1 else grams


def _tables(learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grams of the highest order with their counts, and ``_SUMS`` by size and key of the grams and histories below; all of them."""
    rows = "gram string, t0 bigint, o0 bigint, t1 bigint, o1 bigint"
    counted = learned.select("text", "side").mapInArrow(_count_grams, rows)
    level = top = materialize(counted.groupBy("gram").agg(*(F.sum(x).alias(x) for x in COUNTS)), "grams")
    every = top.select(F.lit(ORDER).alias("size"), "gram", *COUNTS)
    for n in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("t0"))
        every = every.unionByName(level.select(F.lit(n).alias("size"), "gram", "t0", *(F.lit(0).cast("bigint").alias(x) for x in COUNTS[1:])))
    keyed = every.mapInArrow(_keyed, "size int, key bigint, " + ", ".join(f"{x} bigint" for x in _SUMS))
    keyed = materialize(keyed.groupBy("size", "key").agg(*(F.sum(x).cast("int").alias(x) for x in _SUMS)), "gram-sums")
    return top.mapInArrow(_own_keys, "key bigint, t0 bigint, o0 bigint, t1 bigint, o1 bigint").select("key", *(F.col(x).cast("int").alias(x) for x in COUNTS)), keyed


def _counts(learned: DataFrame) -> dict:
    """All counts of a model, as arrays; they grow with the distinct grams of the learned rows."""
    return _arrays(*_tables(learned))


def _arrays(own: DataFrame, keyed: DataFrame) -> dict:
    def arrays(df: DataFrame) -> dict[str, np.ndarray]:
        got = df.toArrow()
        out = {x: got[x].to_numpy() for x in got.column_names}
        return out | {"key": out["key"].view(np.uint64)}

    first = arrays(keyed.where("size = 0").select("key", "n", "k"))
    below = [arrays(keyed.where(f"size = {n}").select("key", *_SUMS[: 3 if n < ORDER - 1 else None])) for n in range(1, ORDER)]
    return {"first": {x: int(first[x].sum()) for x in "nk"}, "below": below, "top": arrays(own)}


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ORDER`` letters for each letter of distinct words, and its place."""
    for batch in batches:
        for a in range(0, batch.num_rows, 5_000):
            words = batch["word"].slice(a, 5_000)
            _, grams, of = hashes(words.to_pylist(), True)
            place = np.arange(len(of)) - np.searchsorted(of, of)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(of)), pa.array(place, pa.int32()), pa.array(grams)], names=["word", "place", "gram"])


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each gram the keys of its ends of 1 ... ``ORDER`` letters (slots 1 ...) and of the 1 ... ``ORDER - 1`` letters before its last (slots -1 ...)."""
    for batch in batches:
        if batch.num_rows:
            grams = batch["gram"].to_pylist()
            ends = {n: [g[-n:] for g in grams] for n in range(1, ORDER + 1)} | {-n: [g[-1 - n : -1] for g in grams] for n in range(1, ORDER)}
            for slot, own in ends.items():
                same = [pa.array(np.full(len(own), x), pa.int32()) for x in (slot, abs(slot))]
                yield pa.RecordBatch.from_arrays([batch["gram"], *same, pa.array(gram_hashes(own).view(np.int64))], names=["gram", "slot", "size", "key"])


def _word_ratios(words: DataFrame, own: DataFrame, keyed: DataFrame) -> DataFrame:
    """``(word, r, r0, r1)``: ratios of distinct words by all counts, and by those of each fold; as ``Ratio.words`` makes them."""
    first = keyed.where("size = 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    total, kinds = float(first.n or 0), float(first.k or 0)
    placed = materialize(words.mapInArrow(_word_grams, "word string, place int, gram string"), "word-grams")
    probes = placed.select("gram").distinct().mapInArrow(_probes, "gram string, slot int, size int, key bigint")
    none = F.lit(0)
    table = keyed.where("size > 0").select("size", "key", *_SUMS, *(none.alias(x) for x in COUNTS))
    table = table.unionByName(own.select(F.lit(ORDER).alias("size"), "key", *(none.alias(x) for x in _SUMS), *COUNTS))
    at = lambda slot, x: F.coalesce(F.max(F.when(F.col("slot") == slot, F.col(x))), none)
    wanted = {f"c{n}": (n, "c") for n in range(1, ORDER)} | {f"{x}{n}": (-n, x) for n in range(1, ORDER - 1) for x in "nk"}
    wanted |= {f"before_{x}": (1 - ORDER, x) for x in _SUMS[3:]} | {f"own_{x}": (ORDER, x) for x in COUNTS}
    found = probes.join(table, ["size", "key"]).groupBy("gram").agg(*(at(*of).alias(x) for x, of in wanted.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda x: batch[x].to_numpy().astype(np.float32)
            both = lambda x, folds: sum(batch[x + f].to_numpy().astype(np.int64) for f in folds).astype(np.float32)
            below, before = [col(f"c{n}") for n in range(1, ORDER)], [(col(f"n{n}"), col(f"k{n}")) for n in range(1, ORDER - 1)]
            made = []
            for fold in ("", "0", "1"):
                sides = [(both(f"own_{x}", fold or "01"), both(f"before_n{x}", fold or "01"), col(f"before_k{x}{fold}")) for x in "to"]
                made.append(pa.array(letter_ratio(total, kinds, below, before, sides)))
            yield pa.RecordBatch.from_arrays([batch["gram"], *made], names=["gram", "r", "r0", "r1"])

    ratios = found.mapInArrow(run, "gram string, r double, r0 double, r1 double")
    parts = placed.join(ratios, "gram", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("r", "r0", "r1"))))).alias("each"))
    summed = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.aggregate("each", F.lit(0.0), lambda had, one: had + one[x])))
    return parts.select("word", *(summed(x).alias(x) for x in ("r", "r0", "r1")))


def _by_words(docs: DataFrame, text_col: str, tables: tuple[DataFrame, DataFrame], schema: T.StructType, make: Callable[[pa.Table, dict[str, Ratio]], pa.Table]) -> DataFrame:
    """What ``make`` gives for each block of ``docs`` and the ratios of the block's own words, by all counts and by fold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(row_slices(batches, text_col)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part + k)), *batch.columns], names=["_block", *batch.schema.names])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in np.unique(batch["_block"].to_numpy()).tolist() if batch.num_rows else []:
                parts, _ = stretches(*utf8(batch["text"].filter(pa.array(batch["_block"].to_numpy() == block))))
                words = sorted(set(chain.from_iterable(words_of(x.decode("utf-8", "surrogatepass")) for x in parts.dictionary.to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(words, pa.string())], names=["_block", "word"])

    # the blocks are written, as they are not the same when they are cut again
    blocks = materialize(docs.mapInArrow(cut, T.StructType([T.StructField("_block", T.LongType()), *docs.schema.fields])), "blocks")
    words = materialize(blocks.select("_block", F.col(text_col).alias("text")).mapInArrow(listed, "_block long, word string").distinct(), "block-words")
    told = words.join(_word_ratios(words.select("word").distinct(), *tables), "word")

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        words = own["word"].to_pylist()
        return make(block, {x: Looked(dict(zip(words, own[x].to_pylist(), strict=True))) for x in ("r", "r0", "r1")})

    return blocks.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(run, schema)


def _whole_column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks) if table.num_rows else pa.array([], pa.string())


def _model(counts: dict, fold: str = "") -> list[dict[str, np.ndarray]]:
    """What ``Ratio`` takes: of all learned rows, or of one fold."""
    *below, last = counts["below"]
    folds = fold or "01"
    add = lambda table, x: sum(table[x + f] for f in folds)
    last = {"key": last["key"], "c": last["c"], **{f"n{s}": add(last, f"n{s}") for s in "to"}, **{f"k{s}": last[f"k{s}{fold}"] for s in "to"}}
    top = counts["top"]
    return [counts["first"], *below, last, {"key": top["key"], **{s: add(top, s) for s in "to"}}]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, x.T @ (weight * (y - p)) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _curve(ins: DataFrame, usable: DataFrame, counts: dict | None, tables: tuple[DataFrame, DataFrame], toxic: int, labels: int) -> np.ndarray | None:
    """The logistic curve, from a bounded sample of each class weighed by its share; None where one class has no documents."""
    share = {c: min(1.0, FITTED_ON / 2 / n) for c, n in ((1, toxic), (0, labels - toxic))}
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    drawn = F.when(F.col("toxic") == 1, part < int(share[1] * (1 << 20))).otherwise(part < int(share[0] * (1 << 20)))
    some = usable.select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).distinct().where(drawn)
    known = _learned(ins, F.broadcast(some)).groupBy("doc_id", "side").agg(F.min("text").alias("text"))  # an id may have many rows
    spark, mark, schema = ins.sparkSession, uuid.uuid4().hex, "side int, " + ", ".join(f"{x} double" for x in FEATURES)
    halves = counts and spark.sparkContext.broadcast([_model(counts, "1"), _model(counts, "0")])

    def features(texts: pa.Array, side: pa.Array, first: Ratio, second: Ratio) -> list[pa.Array]:
        found = np.where((side.to_numpy(zero_copy_only=False) < 2)[:, None], first.texts(texts), second.texts(texts))
        return [side, *(pa.array(found[:, j]) for j in range(len(FEATURES)))]

    def by_words(block: pa.Table, ratios: dict[str, Ratio]) -> pa.Table:
        return pa.table(features(_whole_column(block, "text"), _whole_column(block, "side"), ratios["r1"], ratios["r0"]), names=["side", *FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            models = resident(mark, lambda: [Ratio(x) for x in halves.value])
            yield pa.RecordBatch.from_arrays(features(batch["text"], batch["side"], *models), names=["side", *FEATURES])

    if counts:
        seen = known.select("text", "side").mapInArrow(run, schema).toArrow()
        halves.unpersist()
    else:
        seen = _by_words(known.select("text", "side"), "text", tables, T._parse_datatype_string(schema), by_words).toArrow()
    y = (seen["side"].to_numpy() % 2 == 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    return logistic(np.column_stack([seen[x].to_numpy() for x in FEATURES]), y, weight / weight.mean())


def with_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with ``held_out``, ``score`` and ``predicted`` (columns of these names are replaced).

    A null text counts as empty; a text without words has the score of the
    curve at zero ratios.  Labels whose id or class is null are not learned
    from; repeated labels and ids are learned from and scored each.  Without
    labels, or labelled documents, of both classes every score is the share of
    toxic labels, smoothed (a half where there are none).
    """
    spark = docs.sparkSession
    ins = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = usable.agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("t")).first()
    w = None
    if 0 < n.t < n.n:
        # labels grow with the documents: joined by sorting at every size, rather than broadcast while they are few
        tables = _tables(_learned(ins, usable.hint("merge")))
        counts = _arrays(*tables) if tables[0].count() <= MOST_GRAMS else None
        w = _curve(ins, usable, counts, tables, n.t, n.n)
    if w is None:
        out = docs.drop("held_out", "predicted").withColumn("score", F.lit((n.t + 0.5) / (n.n + 1)))
    elif counts is None:
        held = docs.drop("held_out", "predicted", "score").withColumn(text_col, F.col(text_col).cast("string"))

        def scored(block: pa.Table, ratios: dict[str, Ratio]) -> pa.Table:
            line = ratios["r"].texts(_whole_column(block, text_col)) @ w[:-1] + w[-1]
            return block.drop_columns(["_block"]).append_column("score", pa.array(1 / (1 + np.exp(-np.clip(line, -700, 700)))))

        out = _by_words(held, text_col, tables, T.StructType([*held.schema.fields, T.StructField("score", T.DoubleType())]), scored)
    else:
        model, mark = spark.sparkContext.broadcast(_model(counts)), uuid.uuid4().hex

        def make(texts: pa.Array) -> list[pa.Array]:
            line = resident(mark, lambda: Ratio(model.value)).texts(texts) @ w[:-1] + w[-1]
            return [pa.array(1 / (1 + np.exp(-np.clip(line, -700, 700))))]

        out = with_columns(docs.drop("held_out", "predicted").withColumn(text_col, F.col(text_col).cast("string")), text_col, {"score": "double"}, make)
    return out.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every whole text; see ``with_scores``."""
    found = with_scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return found.select("doc_id", "held_out", "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the toxicity of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
