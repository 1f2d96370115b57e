"""Benchmark decontamination: a prefix-filtered join of benchmark windows with whole documents.

A first pass counts the shingles of all documents in a sketch of fixed size.  Each window of the
benchmark is entered under its rarest shingle by that count, in indexes of bounded size.  With one
index a second pass finds and checks the windows.  With more, the second pass keeps the distinct
texts that hold a prefix shingle of any index, by a bitmap of fixed size, and only these few
are searched index by index: all texts are read twice whatever the benchmark's size.

Occurrences are checked word by word, a word standing for its 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_strings, no_clash, spread_join, written
from .text import ALNUM, mix, runs, window_hashes, word_hashes, words

#: Words of a window, words of a shingle, and bytes of benchmark text that one broadcast index holds.
WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 8 << 20
#: Bits of the filter ahead of the search for shingles.
FILTER_BITS = 20
#: Counters of the sketch of shingle frequencies for each length, the chunks it travels in, and bits of the bitmap of all prefixes, as powers of two.
SKETCH_BITS, CHUNKS, PREFIX_BITS = 20, 16, 26


@dataclass
class Shingles:
    """Sorted shingle hashes of one length with a filter over their low bits."""

    length: int
    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.low(self.hashes)] = True

    @staticmethod
    def low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of word hashes h where a shingle begins, and which; ends: the end of each word's text."""
        g = window_hashes(h, self.length)
        at = np.flatnonzero(self.maybe[self.low(g)])
        at = at[at + self.length <= ends[at]]
        k = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == g[at]
        return at[hit], k[hit]


@dataclass
class Index:
    """Distinct windows of a block of items.

    words (window, WINDOW) holds their word hashes, length their number; offset is the place of the prefix shingle in
    the window; windows of shingle k of a length are order[start[k]:start[k + 1]]; items of
    window i are item[item_start[i]:item_start[i + 1]], indices of ids.
    """

    ids: np.ndarray
    words: np.ndarray
    length: np.ndarray
    item: np.ndarray
    item_start: np.ndarray
    shingles: list[Shingles]
    order: list[np.ndarray]
    start: list[np.ndarray]
    offset: np.ndarray


def _windows(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, and for the distinct windows their word hashes, lengths and items (as pairs window, item)."""
    names = sorted({r[0] for r in rows})
    ids = np.empty(len(names), object)
    ids[:] = names
    place = {x: i for i, x in enumerate(names)}
    owner = [place[r[0]] for r in rows]
    found: dict[bytes, int] = {}
    pairs: set[tuple[int, int]] = set()
    for run in runs(pa.array([r[1] for r in rows], pa.string())):
        w = words(run, ALNUM)
        h = word_hashes(run, w, fold=True)
        for i in range(run.last - run.first):
            own = h[w.index[i] : w.index[i + 1]]
            k = min(WINDOW, len(own))
            for j in range(len(own) - k + 1 if k else 0):
                pairs.add((found.setdefault(own[j : j + k].tobytes(), len(found)), owner[run.first + i]))
    seq = [np.frombuffer(x, np.uint64) for x in found]
    mat = np.zeros((len(seq), WINDOW), np.uint64)
    for i, x in enumerate(seq):
        mat[i, : len(x)] = x
    at = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return ids, mat, np.array([len(x) for x in seq], np.int64), at[:, 0], at[:, 1]


def _shingle_table(mat: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows with shingles of k words, and those shingles' hashes (window, place); places past a window's end are masked by the caller."""
    rows = np.flatnonzero(np.minimum(length, SHINGLE) == k)
    places = WINDOW - k + 1
    g = np.column_stack([window_hashes_at(mat[rows], p, k) for p in range(places)]) if len(rows) else np.zeros((0, places), np.uint64)
    return rows, g


def window_hashes_at(mat: np.ndarray, place: int, k: int) -> np.ndarray:
    flat = np.ascontiguousarray(mat[:, place : place + k]).ravel()
    return window_hashes(flat, k)[::k] if len(flat) else flat


def sketch(docs: DataFrame, text: str) -> np.ndarray:
    """How often shingles of each length occur in all documents, by the low bits of their hash: (SHINGLE, 2 ** SKETCH_BITS) counters."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SHINGLE, size), np.int64)
        for b in batches:
            for run in runs(arrow_strings(b, "text")):
                w = words(run, ALNUM)
                h = word_hashes(run, w, fold=True)
                ends = w.index[1:][w.text]
                for k in range(1, SHINGLE + 1):
                    g = window_hashes(h, k)
                    inside = np.arange(len(g)) + k <= ends[: len(g)]
                    total[k - 1] += np.bincount((g[inside] & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if total.any():
            packed = [zlib.compress(c.tobytes(), 1) for c in np.split(total.ravel(), CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SHINGLE * size // CHUNKS, np.int64)
        for pdf in batches:
            for c in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(c), np.int64)
        yield pd.DataFrame({"chunk": [int(key[0])], "counts": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros((CHUNKS, SHINGLE * size // CHUNKS), np.int64)
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "chunk int, counts binary")
    for r in rows.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():  # CHUNKS rows of a fixed size
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.reshape(SHINGLE, size)


def build(rows: list[tuple[str, str]], often: np.ndarray) -> Index:
    """Index of a block of (item id, text): each window is entered under its rarest shingle by the counts `often` of sketch().

    A window occurs only where all its shingles do, so for containment of the whole
    window one prefix token is enough, and the rarest gives the fewest candidates.
    """
    ids, mat, length, win, item = _windows(rows)
    by_length = [_shingle_table(mat, length, k) for k in range(1, SHINGLE + 1)]
    valid = [np.arange(g.shape[1])[None, :] + k <= length[r][:, None] for k, (r, g) in enumerate(by_length, 1)]
    offset = np.zeros(len(mat), np.int64)
    shingles, order, start = [], [], []
    for k, ((r, g), v, n) in enumerate(zip(by_length, valid, often, strict=True), 1):
        if not len(r):
            continue
        place = np.where(v, n[(g & np.uint64(len(n) - 1)).astype(np.int64)], np.iinfo(np.int64).max).argmin(1)
        offset[r] = place
        prefix = g[np.arange(len(r)), place]
        used, which = np.unique(prefix, return_inverse=True)
        by = np.argsort(which, kind="stable")
        shingles.append(Shingles(k, used))
        order.append(r[by])
        start.append(np.searchsorted(which[by], np.arange(len(used) + 1)))
    return Index(ids, mat, length, item, np.searchsorted(win, np.arange(len(mat) + 1)), shingles, order, start, offset)


def _ragged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans start..end: the number of the span and the place, one entry a place."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which]


def scan(column: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """For each text: number of words, hit word positions (sorted), ids of the items with windows in it."""
    for run in runs(column):
        w = words(run, ALNUM)
        h = word_hashes(run, w, fold=True)
        text = w.text
        ends = w.index[1:][text]
        begin = w.index[:-1][text]
        hits, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t, order, start in zip(index.shingles, index.order, index.start, strict=True):
            at, k = t.find(h, ends)
            which, place = _ragged(start[k], start[k + 1])
            win = order[place]
            first = at[which] - index.offset[win]
            # the window has to lie within the text
            ok = first >= begin[at[which]]
            ok &= first + index.length[win] <= ends[at[which]]
            first, win = first[ok], win[ok]
            same = np.ones(len(first), bool)
            for j in range(WINDOW):
                live = np.flatnonzero(same & (j < index.length[win]))
                same[live] = h[first[live] + j] == index.words[win[live], j]
            hits.append(first[same])
            wins.append(win[same])
        first, win = np.concatenate(hits), np.concatenate(wins)
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + index.length[win], -1)
        hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        cutpoints = np.searchsorted(hit, w.index)
        which, place = _ragged(index.item_start[win], index.item_start[win + 1])
        pairs = np.unique(text[first[which]] * len(index.ids) + index.item[place]) if len(which) else np.zeros(0, np.int64)
        owner = pairs // max(1, len(index.ids))
        for i in range(run.last - run.first):
            lo, hi = np.searchsorted(owner, (i, i + 1))
            yield int(w.index[i + 1] - w.index[i]), hit[cutpoints[i] : cutpoints[i + 1]] - w.index[i], [str(x) for x in index.ids[pairs[lo:hi] % len(index.ids)]] if hi > lo else []


def blocks(docs: DataFrame, benchmark: DataFrame, text: str, item: str, block_bytes: int) -> Iterator[Index]:
    """Indexes of bounded blocks of the benchmark, one after the other: items are dealt to blocks by a hash of their id."""
    b = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    size = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // block_bytes)
    often = sketch(docs, text) if n else np.zeros((SHINGLE, 1), np.int64)
    for k in range(n):
        yield build([(r["i"], r["t"]) for r in b.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()], often)
    if not n:
        yield build([], often)


_FOUND = "n_words long, n_hit long, hits array<int>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of every row of docs, n_words, n_hit, hits (positions of hit words), items (ids, sorted as strings).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A
    window is WINDOW consecutive words of an item, or a shorter item as a whole; a
    document's word is hit if an occurrence of a window covers it.

    The benchmark is read in blocks of at most about block_bytes, each broadcast as an index.
    Rows without text have no words; items without an id or text have no windows;
    items of one id are one item; equal rows are judged alike; empty tables of either kind give
    no hits.  A column of `keep` named like a result is a ValueError.
    """
    no_clash(keep, ["n_words", "n_hit", "hits", "items"])
    row = F.struct(*keep) if keep else F.struct(F.lit(None).alias("none"))
    rows = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    indexes = _held(blocks(docs, benchmark, text, item, block_bytes), docs)
    if len(indexes) == 1:
        out = _searched(rows, indexes[0][0])
    else:
        kind = rows.schema["row"]
        counted = rows.select("row", F.md5("text").alias("id"), "text").mapInArrow(_count_words, T.StructType([kind, *T._parse_datatype_string("id string, n_words long").fields]))
        out = spread_join(written(counted, "counted"), _in_blocks(rows, indexes), ["id"])
    none = {"n_hit": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    return out.select("row.*", "n_words", *(F.coalesce(c, x).alias(c) for c, x in none.items())).withColumn("items", F.array_sort("items"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, without a hit word."""
    indexes = _held(blocks(docs, benchmark, text, item, block_bytes), docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    if len(indexes) == 1:
        return _searched(rows, indexes[0][0]).where("n_hit = 0").select("row.*")
    gone = _in_blocks(rows, indexes).select("id")
    return docs.join(gone, F.md5(docs[text].cast("string")) == gone["id"], "left_anti")


Held = tuple[Broadcast, np.ndarray]


def _held(indexes: Iterator[Index], docs: DataFrame) -> list[Held]:
    """Each index as a broadcast, and the places of its prefix shingles in the bitmap; the driver keeps no index."""
    return [(docs.sparkSession.sparkContext.broadcast(x), np.concatenate([np.zeros(0, np.int64), *(_place(t.hashes, t.length) for t in x.shingles)])) for x in indexes]


def _place(g: np.ndarray, length: int) -> np.ndarray:
    return (mix(g + np.uint64(length)) >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)


def _searched(rows: DataFrame, index: Broadcast) -> DataFrame:
    """row, n_words, n_hit, hits and items (null without a hit) of rows (row, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit, hits, items = [], [], [], []
            for n, hit, ids in scan(arrow_strings(b, "text"), index.value):
                n_words.append(n)
                n_hit.append(len(hit))
                hits.append(hit.astype(np.int32) if len(hit) else None)
                items.append(ids if len(hit) else None)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "n_hit", "hits", "items"])

    return rows.mapInArrow(check, T.StructType([rows.schema["row"], *T._parse_datatype_string(_FOUND).fields]))


def _in_blocks(rows: DataFrame, indexes: list[Held]) -> DataFrame:
    """(id, copies, n_hit, hits, items) of every distinct text of rows with a hit; id is the text's md5.

    One pass keeps the texts that hold a prefix shingle of any index; only those are searched index by index.
    """
    marked = np.zeros(1 << PREFIX_BITS, bool)
    for _, places in indexes:
        marked[places] = True
    bits = rows.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for run in runs(arrow_strings(b, "text")):
                w = words(run, ALNUM)
                h = word_hashes(run, w, fold=True)
                text = w.text
                ends = w.index[1:][text]
                hit = np.zeros(run.last - run.first, bool)
                for k in range(1, SHINGLE + 1):
                    g = window_hashes(h, k)
                    at = _place(g, k)
                    on = (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                    on &= np.arange(len(g)) + k <= ends[: len(g)]
                    hit[text[: len(g)][on]] = True
                keep.append(hit)
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    some = rows.select("text").where("text is not null").mapInArrow(possible, "text string")
    texts = written(some.groupBy(F.md5("text").alias("id")).agg(F.first("text").alias("text"), F.count("*").alias("copies")), "possible")
    found = [_searched(texts.select(F.struct("id", "copies").alias("row"), "text"), index).where("n_hit > 0") for index, _ in indexes]
    every = reduce(DataFrame.unionByName, found).groupBy("row.id", "row.copies")  # a row an index at most
    merged = every.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return written(merged.withColumn("n_hit", F.size("hits").cast("long")), "hits")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [np.zeros(0, np.int64), *(np.diff(words(run, ALNUM).index) for run in runs(arrow_strings(b, "text")))]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(np.concatenate(n), pa.int64())], names=["row", "id", "n_words"])
