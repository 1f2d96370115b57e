"""Quality rules: rule statistics of whole texts and an isolation forest calibrated from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_strings, no_clash
from .text import MIX_B, NON_SPACE, Run, Words, mix, runs, window_hashes, word_hashes, words

#: Columns of the statistics.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Share of good rows whose repetition counts as none.
TAIL = 0.999
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_FIRST = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATS for each text (null: empty); whole texts, whatever their length."""
    out = [np.zeros((0, len(STATS)), np.int64)]
    for run in runs(column):
        n = run.last - run.first
        w = words(run, NON_SPACE)
        text = w.text
        h = word_hashes(run, w, fold=False)
        salt = mix(np.arange(1, n + 1, dtype=np.uint64) * MIX_B)
        in_word = NON_SPACE[run.data]
        s = np.zeros((n, len(STATS)), np.int64)
        s[:, 0] = np.diff(w.index)
        for at, flags in ((1, in_word & _FIRST[run.data]), (2, _SYMBOL[run.data])):
            s[:, at] = _sums(flags, run.bounds)
        s[:, 3] = _repeated_lines(run, w, salt, n)
        # words of 3-word windows that the text holds more than once
        g = window_hashes(h, 3)
        inside = text[: len(g)] == text[2:] if len(g) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        _, first, count = np.unique(g[at] ^ salt[text[at]], return_inverse=True, return_counts=True)
        often = at[count[first] > 1] if len(at) else at
        hit = np.zeros(len(h), bool)
        for k in range(3):
            hit[often + k] = True
        s[:, 4] = _sums(hit, w.index)
        out.append(s)
    return np.concatenate(out)


def _repeated_lines(run: Run, w: Words, salt: np.ndarray, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    feed = np.flatnonzero(run.data == 10)
    start = np.concatenate([run.bounds[:-1], feed + 1])
    end = np.concatenate([run.bounds[1:], feed])
    text = np.concatenate([np.arange(n), np.searchsorted(run.bounds, feed, "right") - 1])
    by_text = np.lexsort((start, text))
    # the ends of a text's lines, in order, are its line feeds and its own end
    end = end[np.lexsort((end, text))]
    start, text = start[by_text], text[by_text]
    with_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, text = start[with_word], end[with_word], text[with_word]
    if not len(start):
        return np.zeros(n, np.int64)
    h = _span_hashes(run.data, start, end) ^ salt[text]
    later = np.ones(len(h), bool)
    later[np.unique(h, return_index=True)[1]] = False
    return np.bincount(text[later], minlength=n)


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return word_hashes(Run(0, 0, data, np.zeros(0, np.int64)), Words(start, end, np.zeros(0, np.int64)), fold=False)


def rates(s: np.ndarray) -> np.ndarray:
    """Characters, symbols, repeated lines and words of repeated windows a word, from rows of STATS."""
    n = np.maximum(s[:, 0], 1)
    return np.column_stack([s[:, at] / n for at in (1, 2, 3, 4)])


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])


@dataclass
class Forest:
    """Trees as arrays (tree, node): feature (-1: leaf), split, and path length of a leaf; node i has the children 2i + 1 and 2i + 2.

    Rates below `floor` count as the floor.
    """

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    sample: int
    floor: np.ndarray
    threshold: float = 1.0

    def features(self, s: np.ndarray) -> np.ndarray:
        """What the trees split on, from rows of STATS."""
        return np.maximum(rates(s), self.floor)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for rows that random splits isolate early."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, v, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(_depth(self.sample)):
                at = f[node]
                node = np.where(at < 0, node, 2 * node + 1 + (x[rows, at] >= v[node]))
            total += path[node]
        return 2.0 ** -(total / len(self.feature) / _expected(self.sample))


def _depth(sample: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, sample)))))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int, sample: int, seed: int, floor: np.ndarray) -> Forest:
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    deep = _depth(sample)
    size = 2 ** (deep + 1)
    f, v, p = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, rng.choice(len(x), sample, replace=False))]
        while todo:
            node, depth, rows = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            open_ = np.flatnonzero(high > low)
            if depth == deep or len(rows) < 2 or not len(open_):
                p[t, node] = depth + _expected(len(rows))
                continue
            at = rng.choice(open_)
            cut = rng.uniform(low[at], high[at])
            right = x[rows, at] >= cut
            if right.all():
                right = x[rows, at] > low[at]
                cut = x[rows[right], at].min()
            f[t, node], v[t, node] = at, cut
            todo += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(f, v, p, sample, floor)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labels: int = 20_000, trees: int = 200, sample: int = 256, bad_share: float = 0.02, keep_clean: float = 0.995, clean_weight: float = 20.0, margin: float = 0.25, seed: int = 17) -> Forest:
    """Fits the forest and its threshold on at most `max_labels` labelled rows, those of the smallest hashes of their key.

    The trees grow from samples of the good rows with a share `bad_share` of the others (or what
    there is), so that bad rows are few and far from the rest and random splits isolate them
    early.  Repetition that 99.9 % of the good rows stay within (TAIL) counts as none, since its long tail in clean text would hide everything else; what exceeds it shortens
    the paths.  The threshold is calibrated on all these rows by calibrated().  Rows that fail
    the base rules take no part.  With fewer than two good rows the forest rejects nothing.

    Labels without a key or label say nothing; of several labels of a key the lowest counts, and
    rows of one key are rows of their own.  Keys may be of any type that sorts.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    picked = picked.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(max_labels)
    # at most max_labels rows of two numbers, hence the broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "k")
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), *(T.StructField(c, T.LongType()) for c in ("y", *STATS))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = statistics(arrow_strings(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y").cast(pa.int64()), *(pa.array(c) for c in s.T)], names=schema.names)

    found = rows.select("k", "y", "text").mapInArrow(count, schema).orderBy("k", *STATS).limit(max_labels).toPandas()
    s = found[list(STATS)].to_numpy(np.int64).reshape(-1, len(STATS))
    good = found["y"].to_numpy() > 0
    ok = ~base_failed(s)
    x, good = rates(s[ok]), good[ok]
    if good.sum() < 2:
        return Forest(np.full((1, 2), -1), np.zeros((1, 2)), np.ones((1, 2)), 2, np.zeros(x.shape[1]), np.inf)
    floor = np.concatenate([[0.0, 0.0], np.quantile(x[good][:, 2:], TAIL, axis=0, method="higher")])
    x = np.maximum(x, floor)
    bad = np.random.default_rng(seed).permutation(np.flatnonzero(~good))[: int(np.ceil(bad_share * good.sum()))]
    forest = grow(x[np.concatenate([np.flatnonzero(good), bad])], trees, sample, seed, floor)
    score = forest.score(x)
    forest.threshold = calibrated(score[good], score[~good], keep_clean, clean_weight, margin)
    return forest


def calibrated(good: np.ndarray, bad: np.ndarray, keep_clean: float, clean_weight: float, margin: float) -> float:
    """The threshold of the least cost, clean_weight * (share of good above) + (share of bad not above), that keeps `keep_clean` of the good.

    It lies by `margin` of the gap above the scores that it lets pass, towards the next one.
    """
    scores = np.unique(np.concatenate([good, bad]))
    lost = 1 - np.searchsorted(np.sort(good), scores, "right") / len(good)
    left = np.searchsorted(np.sort(bad), scores, "right") / max(1, len(bad))
    cost = np.where(lost <= 1 - keep_clean + 1e-12, clean_weight * lost + left, np.inf)
    at = len(cost) - 1 - int(cost[::-1].argmin())  # of equal costs the highest threshold
    above = scores[at + 1] if at + 1 < len(scores) else scores[at]
    return float(scores[at] + margin * (above - scores[at]))


def judge(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, STATS, score, base_failed and kept for every row of docs; one pass without a shuffle.

    A null text has no words, so it fails the base rules; equal rows are judged alike; an empty
    table gives no rows; other columns are left alone.  A key named like a result is a ValueError.
    """
    no_clash([key], [*STATS, "score", "base_failed", "kept"])
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in STATS), T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, score, failed, kept = verdicts(arrow_strings(b, "text"), forest)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in s.T), pa.array(score), pa.array(failed), pa.array(kept)], names=schema.names)

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(check, schema)


def verdicts(column: pa.Array, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s = statistics(column)
    score = forest.score(forest.features(s))
    failed = base_failed(s)
    return s, score, failed, ~failed & (score <= forest.threshold)


def keep_good(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that judge() keeps."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdicts(arrow_strings(b, text), forest)[3]))

    return docs.mapInArrow(check, docs.schema)

