"""Token-ID output: documents encoded to Parquet list columns and read back."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_strings, no_clash, parts
from .text import Run, Words, runs, word_hashes

#: Encoded pieces that a worker keeps; beyond it the cache starts anew (it never changes results).
CACHE_PIECES = 2_000_000
#: Of the files: bytes of a row group, bytes and rows of a page.
ROW_GROUP, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2_000

_byte = np.arange(256)
_letter = (_byte >= 97) & (_byte <= 122) | (_byte >= 65) & (_byte <= 90)
_mark = (_byte > 32) & (_byte < 127) & ~_letter & ~((_byte >= 48) & (_byte <= 57)) & (_byte != 39)
#: First bytes of characters that are certainly not white space.
_visible = (_byte > 32) & (_byte < 127) | (_byte >= 0xC3) & (_byte <= 0xE0) | (_byte >= 0xE4)
_gap = np.isin(_byte, [10, 32])


def pieces(run: Run, added: Words | None = None) -> Words:
    """Cuts a run of texts where its pre-tokenizer is certain to end a token.

    That is before a space or line feed with a visible character behind it, as only the
    last character of white space stands alone or joins the next word, and between an
    ASCII letter and an ASCII mark other than the apostrophe of contractions.  Encoding
    the pieces gives the ids of the text; a missed cut only makes a piece longer.  The spans
    `added` (of added tokens, which split a text before the pre-tokenizer sees it) are pieces
    as they are, and white space before one ends its part of the text.
    """
    d = run.data
    cut = np.zeros(len(d) + 1, bool)
    if len(d) > 1:
        cut[: len(d) - 1] = _gap[d[:-1]] & _visible[d[1:]]
        cut[1 : len(d)] |= _letter[d[:-1]] & _mark[d[1:]]
    cut[run.bounds[1:][run.bounds[1:] > 0] - 1] = False  # what follows is another text
    if added is not None:
        cut[np.maximum(added.start - 1, 0)] &= ~_gap[d[np.maximum(added.start - 1, 0)]]
        inside = np.cumsum(np.bincount(added.start, minlength=len(cut)) - np.bincount(added.end, minlength=len(cut))) > 0
        cut &= ~inside
        cut[added.start] = cut[added.end] = True
    cut[run.bounds[:-1][run.bounds[:-1] < run.bounds[1:]]] = True
    start = np.flatnonzero(cut[: len(d)])
    return Words(start, np.append(start[1:], len(d)) if len(start) else start, np.searchsorted(start, run.bounds))


#: An optional space and letters, ASCII or Latin-1, in UTF-8.
_one_word = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
# how a byte-level vocabulary shows bytes: printable ones as themselves, the others from 256 on
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _printable)}
_shown_space = chr(_shown[32])


class Encoder:
    """Ids of whole texts by a tokenizers file; each distinct piece is encoded once while the cache holds it.

    Added tokens of the file (special ones too) found in a text get their own ids, as the
    library gives them.  Where one of them takes white space along, asks for whole words or is
    sought in normalised text, a text with its string is encoded as one piece.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words = self.model.model
        tokens = [t for t in self.model.get_added_tokens_decoder().values() if t.content]
        self.added = {t.content.encode() for t in tokens}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or (t.normalized and self.model.normalizer is not None) for t in tokens)
        # the leftmost match wins, of several there the longest
        self.find = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))).finditer if tokens else None
        self.folded = [x.decode().lower() for x in self.added]
        self.clear()

    def spans(self, run: Run) -> Words | None:
        """The spans of a run that stand for added tokens, or are texts to be encoded as one piece."""
        if self.find is None:
            return None
        data = run.data.tobytes()
        at: list[tuple[int, int]] = []
        if self.plain:
            if next(self.find(data), None) is None:
                return None
            for lo, hi in zip(run.bounds[:-1].tolist(), run.bounds[1:].tolist(), strict=True):
                at += [m.span() for m in self.find(data, lo, hi)]
        else:
            for lo, hi in zip(run.bounds[:-1].tolist(), run.bounds[1:].tolist(), strict=True):
                text = data[lo:hi].decode().lower()
                if any(x in text for x in self.folded):
                    at.append((lo, hi))
        if not at:
            return None
        start, end = np.array(at, np.int64).T
        return Words(start, end, run.bounds)

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def learn(self, h: np.ndarray, texts: list[bytes]) -> None:
        """Adds pieces by their hashes, which ascend."""
        new: list = [None] * len(texts)
        rest = []
        for i, x in enumerate(texts):
            if x not in self.added and _one_word(x):  # the pre-tokenizer leaves it whole, so the model alone encodes it
                shown = x.decode("latin-1")
                shown = shown.replace(" ", _shown_space) if x.isascii() else shown.translate(_shown)
                new[i] = [t.id for t in self.words.tokenize(shown)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.model.encode_batch_fast([texts[i].decode() for i in rest], add_special_tokens=False), strict=True):
            new[i] = e.ids
        length = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.int64, int(length.sum()))
        kind = np.uint32 if len(flat) and flat.max() > 65_535 else self.ids.dtype
        at = np.searchsorted(self.known, h)
        self.known = np.insert(self.known, at, h)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.ids = np.concatenate([self.ids.astype(kind, copy=False), flat.astype(kind)])

    def encode(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run, and the number of ids of each text."""
        w = pieces(run, self.spans(run))
        h, first, back = np.unique(word_hashes(run, w, fold=False), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > CACHE_PIECES:
            self.clear()
        at = np.searchsorted(self.known, h)
        missing = at == len(self.known)
        if len(self.known):
            missing |= self.known[np.minimum(at, len(self.known) - 1)] != h
        if missing.any():
            f = first[missing]
            self.learn(h[missing], [run.data[s:e].tobytes() for s, e in zip(w.start[f].tolist(), w.end[f].tolist(), strict=True)])
            at = np.searchsorted(self.known, h)
        at = at[back]
        n = self.length[at]
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(self.start[at], n)
        return self.ids[place], np.diff(total[w.index])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, appends end_id and writes Parquet files (part, before, n_tokens, key, tokens) in ascending key order.

    Rows are dealt out by range of the key and sorted; file and row order are the order of
    the keys (nulls first, rows of one key in the order of a hash of their text).  A
    null text is empty and so has end_id alone.  Tokens are delta or dictionary
    encoded, row groups and pages are small, and page indexes are written, so that a
    reader of some keys or of the metadata alone skips the rest.  Other columns are left
    alone; a key named like a column of the files is a ValueError.  An empty table gives
    files without rows.
    """
    no_clash([key], ["part", "before", "n_tokens", "tokens", "start", "ids_crc32"])
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField(key, docs.schema[key].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            for run in runs(arrow_strings(b, "text")):
                ids, n = encoder(tokenizer).encode(run)
                ends = np.cumsum(n)
                flat = np.insert(ids.astype(np.int32), ends, end_id)
                bounds = np.concatenate([[0], np.cumsum(n + 1)])
                rows = run.last - run.first
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, part), pa.int32()), pa.array(seen + bounds[:-1], pa.int64()), pa.array(n + 1, pa.int64()), b.column("k").slice(run.first, rows), lists], names=schema.names)
                seen += int(bounds[-1])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("k"), F.col("tie")]
    dealt = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("k", "text")
    out = dealt.mapInArrow(encode, schema).write
    for name, value in {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": ROW_GROUP,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
    }.items():
        out = out.option(name, str(value))
    out.parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", keys: tuple[int, int] | None = None) -> DataFrame:
    """key, start (ids of all documents before), n_tokens and tokens, from the files alone.

    Starts come from each row's place in its file (before: ids ahead of it there) and the
    files' totals.  With `keys`, a first and a last key, only rows between them are read: the files
    are in key order, so row groups and pages of other keys are skipped by their statistics.
    """
    return _chosen(_with_starts(spark.read.parquet(path), _bases(spark, path)), key, keys).select(key, "start", "n_tokens", "tokens")


def read_sizes(spark: SparkSession, path: str, key: str = "doc_id", keys: tuple[int, int] | None = None) -> DataFrame:
    """key, start and n_tokens; no list of tokens is read."""
    return _chosen(_with_starts(spark.read.parquet(path), _bases(spark, path)), key, keys).select(key, "start", "n_tokens")


def _chosen(rows: DataFrame, key: str, keys: tuple[int, int] | None) -> DataFrame:
    return rows if keys is None else rows.where(F.col(key).between(*keys))


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """(file, base): how many ids the files before hold; a row a file, from two small columns."""
    last = spark.read.parquet(path).groupBy(F.col("part").alias("file")).agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("file", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"))


def _with_starts(files: DataFrame, bases: DataFrame) -> DataFrame:
    """files with start: the row's place in its file plus the sizes of the files before."""
    return files.join(F.broadcast(bases), F.col("part") == F.col("file")).withColumn("start", F.col("base") + F.col("before"))


def digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and the crc32 of the ids (little-endian unsigned 32 bits), read from the files."""
    kind = spark.read.parquet(path).schema
    schema = T.StructType([kind[key], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            bounds = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            view = memoryview(np.ascontiguousarray(data)).cast("B")
            crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("start"), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return read_tokens(spark, path, key).select(key, "start", "tokens").mapInArrow(check, schema)
