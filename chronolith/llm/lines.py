"""Line dedup: distinct-site spread of lines by HyperLogLog sketches, exact near the threshold, and removal of boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_strings, cut, small
from .text import NON_SPACE, Run, Words, runs, word_hashes, words

#: log2 of a sketch's buckets (a relative error of about 1.6 %), and the band around the threshold that is counted exactly.
SKETCH_BITS, BAND = 12, 0.15
#: Boilerplate lines that one broadcast holds (8 MB).
BLOCK_LINES = 1 << 20


def line_spans(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a run: text, first and last byte as they stand, and hash of the line without surrounding white space (and whether it has a word)."""
    n = len(run.bounds) - 1
    feed = np.flatnonzero(run.data == 10)
    start = np.concatenate([run.bounds[:-1], feed + 1])
    text = np.concatenate([np.arange(n), np.searchsorted(run.bounds, feed, "right") - 1])
    by = np.lexsort((start, text))
    start, text = start[by], text[by]
    end = np.concatenate([run.bounds[1:], feed])
    end = end[np.lexsort((end, np.concatenate([np.arange(n), np.searchsorted(run.bounds, feed, "right") - 1])))]
    w = words(run, NON_SPACE)
    lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    full = hi > lo
    h = np.zeros(len(start), np.uint64)
    if full.any():
        h[full] = word_hashes(run, Words(w.start[lo[full]], w.end[hi[full] - 1], np.zeros(0, np.int64)), fold=False)
    return text, start, end, h.view(np.int64), full


def line_sites(docs: DataFrame) -> DataFrame:
    """(h, site): lines with a word of docs (text, site), each once for every site of a batch."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in runs(arrow_strings(b, "text")):
                text, _, _, h, full = line_spans(run)
                site = b.column("site").slice(run.first, run.last - run.first).dictionary_encode()
                code = site.indices.to_numpy()[text[full]]
                pair = np.unique(np.column_stack([h[full], code]), axis=0) if len(code) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), site.dictionary.take(pa.array(pair[:, 1]))], names=["h", "site"])

    return docs.mapInArrow(go, "h long, site string")


def boilerplate(docs: DataFrame, min_sites: int) -> DataFrame:
    """(h) of the lines on min_sites distinct sites and more.

    Sketches combine before the shuffle, so a line that is everywhere is a few rows a task.
    Lines whose estimate is within BAND of the threshold are counted exactly; the
    count is again of combined distinct pairs.
    """
    seen = line_sites(docs)
    spread = cut(seen.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND)))
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("h")
    exact = seen.join(small(near, near.count()), "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") > min_sites * (1 + BAND)).select("h").union(exact.select("h"))


def drop_boilerplate(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source", block_lines: int = BLOCK_LINES) -> DataFrame:
    """All columns of docs with `text` without boilerplate lines, and n_lines and n_removed.

    A line is what line feeds part; lines are the same if they are without surrounding
    ASCII white space.  A line with a word is boilerplate if at least min_sites distinct
    sites have it (a null site counts as one); all its occurrences go, other lines stay as
    they are.  Null texts stay null and have no lines; equal rows are treated alike; an
    empty table gives no rows.  Columns named n_lines and n_removed are replaced.

    Boilerplate hashes are broadcast in blocks of bounded size; with more than one block
    the documents pass once a block.
    """
    slim = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"))
    found = cut(boilerplate(slim, min_sites))
    blocks = -(-found.count() // block_lines)
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = docs.select(F.struct(*others).alias("row"), F.col(text).cast("string").alias("text"), F.lit(None).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    for k in range(max(1, blocks)):
        hashes = np.sort(np.array([r[0] for r in found.where(F.pmod(F.xxhash64("h"), F.lit(max(1, blocks))) == k).collect()], np.int64))
        out = _without(cut(out) if k else out, hashes)
    return out.select(*(F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in others), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "n_removed")


def _without(rows: DataFrame, hashes: np.ndarray) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(hashes)
    schema: T.StructType = rows.schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = arrow_strings(b, "text")
            texts, n_lines, n_removed = [], [], []
            for run in runs(column):
                text, start, end, h, full = line_spans(run)
                n = run.last - run.first
                at = np.minimum(np.searchsorted(held.value, h), max(0, len(held.value) - 1))
                gone = full & (held.value[at] == h) if len(held.value) else np.zeros(len(h), bool)
                lines = np.searchsorted(text, np.arange(n + 1))
                removed = np.bincount(text[gone], minlength=n)
                data = run.data.tobytes()
                for i in range(n):
                    if removed[i]:
                        keep = [j for j in range(lines[i], lines[i + 1]) if not gone[j]]
                        texts.append(b"\n".join(data[start[j] : end[j]] for j in keep))
                    else:
                        texts.append(data[run.bounds[i] : run.bounds[i + 1]])
                n_lines += np.diff(lines).tolist()
                n_removed += removed.tolist()
            null = column.is_null().to_numpy(zero_copy_only=False)
            first = b.column("n_lines").to_pylist()
            before = b.column("n_removed").to_pylist()
            texts = [None if z else t for t, z in zip(texts, null, strict=True)]
            n_lines = [(0 if z else n) if f is None else f for n, z, f in zip(n_lines, null, first, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array([x + y for x, y in zip(before, n_removed, strict=True)], pa.int64())], names=["row", "text", "n_lines", "n_removed"])

    return rows.mapInArrow(go, schema)
