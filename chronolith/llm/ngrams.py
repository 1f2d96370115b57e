"""N-gram Jaccard join: a blocked sparse product of documents by word n-grams with size-derived bounds.

Documents with equal n-gram sets form a class, of which one represents all.  Columns of
the product are n-grams in one global order, frequent ones last; a pair that links must
share one of the first n - ceil(0.8 n) + 1 n-grams of either set, so only those prefix
columns are multiplied.  Each short column adds to the overlap counts of its pairs, and
pairs whose prefix overlap plus what may follow stays below the overlap that their
sizes ask for are dropped.  The documents of a long column form a star around one of them,
the same one for columns of much the same documents; stars are never joined to larger groups.

Links are counted in full before anything is grouped.  First go each document against the
centre of its stars and against one partner: that joins dense groups of copies up in linear
work.  What is left are candidate pairs across the components so found, counted one by
one, and stars that reach over several components, multiplied in blocks of bounded size
between different components only; a spanning forest of a block's links leaves it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_strings, components, no_clash, spread_join, written
from .text import MIX_A, NON_SPACE, Run, U, mix, runs, sequence_hash, window_hashes, word_hashes, words

#: Words of an n-gram, and the similarity that links, as a fraction.
N, TOP, BOTTOM = 5, 4, 5
#: Counters of the frequency sketch (a fixed size, whatever the input), and chunks that it travels in.
SKETCH, CHUNKS = 1 << 21, 32
#: Documents of a short column at most; documents and bytes of sets of a block.
SHORT, BLOCK_DOCS, BLOCK_BYTES = 128, 1500, 24 << 20
#: Bytes of an n-gram's hash.
WIDTH = 8
#: Bits of the bitmap of documents whose sets are counted in full, as a power of two (8 MB).
MARK_BITS = 26
_HALF = U(1 << 63)


def shingle_sets(run: Run, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All sets of a run as (hashes, bounds); each ascends by hash, or with `order` by (class, hash) with the classes of rank()."""
    w = words(run, NON_SPACE)
    h = word_hashes(run, w, fold=True)
    n = run.last - run.first
    text = w.text
    g = window_hashes(h, N)
    whole = np.flatnonzero(text[: len(g)] == text[N - 1 :]) if len(g) else np.zeros(0, np.int64)
    g, owner = g[whole], text[whole]
    few = np.flatnonzero((np.diff(w.index) > 0) & (np.diff(w.index) < N))
    if len(few):
        g = np.concatenate([g, np.array([sequence_hash(h[w.index[i] : w.index[i + 1]]) for i in few], np.uint64)])
        owner = np.concatenate([owner, few])
    by = _sorted(n, owner, None if order is None else rank(g, order), g)
    g, owner = g[by], owner[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(n + 1))


def _sorted(n: int, owner: np.ndarray, grade: np.ndarray | None, g: np.ndarray) -> np.ndarray:
    """The order by (owner, grade, hash): one sort of as many leading bits as a word holds, checked, and a full sort where they tie."""
    width = max(1, int(n).bit_length())
    key = owner.astype(np.uint64) << U(64 - width)
    if grade is not None:
        width += 7
        key |= grade.astype(np.uint64) << U(64 - width)
    key |= g >> U(width)
    by = np.argsort(key)
    key, h = key[by], g[by]
    if ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
        return np.lexsort((g, owner) if grade is None else (g, grade, owner))
    return by


def bucket(g: np.ndarray) -> np.ndarray:
    return (g & U(SKETCH - 1)).astype(np.int64)


def rank(g: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Class of each n-gram in the global order: 0 rare, 1 not counted, above that the more frequent the later."""
    seen = order[bucket(g)]
    return np.where(seen > 0, seen + 1, (g >= _HALF).astype(seen.dtype))


def classes_of(counts: np.ndarray) -> np.ndarray:
    """For each counter 0 if chance explains it, or 1 and more by the logarithm of its excess over the mean."""
    mean = counts.mean()
    excess = counts - mean
    return np.where(excess <= 8 * np.sqrt(mean) + 8, 0, 1 + np.log2(np.maximum(excess, 1))).astype(np.int8)


def profile(docs: DataFrame) -> DataFrame:
    """Of docs (k, text): a row (k, n, f1, f2, null) a document and rows (chunk, null, null, null, counts) of the sketch a task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        names = ["k", "n", "f1", "f2", "counts"]
        for b in batches:
            for run in runs(arrow_strings(b, "text")):
                g, bounds = shingle_sets(run)
                counts += np.bincount(bucket(g[g < _HALF]), minlength=SKETCH)
                f = digests(g, bounds)
                rows = run.last - run.first
                yield pa.RecordBatch.from_arrays([b.column("k").slice(run.first, rows), pa.array(np.diff(bounds)), pa.array(f[0]), pa.array(f[1]), pa.nulls(rows, pa.binary())], names=names)
        none = pa.nulls(CHUNKS, pa.int64())
        if counts.any():
            packed = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in np.split(counts, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int64()), none, none, none, pa.array(packed, pa.binary())], names=names)

    return docs.mapInArrow(go, "k long, n long, f1 long, f2 long, counts binary")


def sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all sketches; what reaches the driver has the sketch's fixed size."""

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH // CHUNKS, np.int64)
        for pdf in batches:
            for c in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(c), "<u4")
        yield pd.DataFrame({"k": [int(key[0])], "counts": [zlib.compress(total.tobytes(), 1)]})

    total = np.zeros((CHUNKS, SKETCH // CHUNKS), np.int64)
    for r in rows.where("counts is not null").select("k", "counts").groupBy("k").applyInPandas(add, "k long, counts binary").collect():
        total[r["k"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return total.ravel()


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of sizes a and b."""
    return -(-TOP * (a + b) // (TOP + BOTTOM))


def digests(g: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set, whatever its order."""
    sums = [np.concatenate([[U(0)], np.cumsum(x)]) for x in (mix(g), mix(g ^ MIX_A))]
    return [mix(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]


def prefixes(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """(k, n, f1, f2, p) of each document of docs (k, text) with words: its set's size and hashes, and its prefix in the global order, 8 bytes an n-gram."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in runs(arrow_strings(b, "text")):
                g, bounds = shingle_sets(run, held.value)
                n = np.diff(bounds)
                size = np.where(n > 0, n - -(-TOP * n // BOTTOM) + 1, 0)
                f = digests(g, bounds)
                p = [g[x : x + m].tobytes() for x, m in zip(bounds[:-1], size, strict=True)]
                rows = pa.RecordBatch.from_arrays([b.column("k").slice(run.first, len(n)), pa.array(n, pa.int32()), pa.array(f[0]), pa.array(f[1]), pa.array(p, pa.binary())], names=["k", "n", "f1", "f2", "p"])
                yield rows.filter(pa.array(n > 0))

    return docs.mapInArrow(go, "k long, n int, f1 long, f2 long, p binary")


def entries(packed: DataFrame) -> DataFrame:
    """(h, k, n, i): the n-gram at place i of each prefix."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                p = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("p")]
                size = np.array([len(x) for x in p])
                row = np.repeat(np.arange(len(p)), size)
                i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)), part.column("k").take(pa.array(row)), part.column("n").take(pa.array(row)), pa.array(i, pa.int32())], names=["h", "k", "n", "i"])

    return packed.select("k", "n", "p").mapInArrow(go, "h long, k long, n int, i int")


_PAIRS = "a long, b long, na int, nb int, c long, ra int, rb int"
_PAIR_NAMES = ["a", "b", "na", "nb", "c", "ra", "rb"]


def columns_to_pairs(rows: DataFrame, short: int = SHORT) -> DataFrame:
    """Multiplies columns: pair rows of short ones, and rows (centre, document, 0, ...) that tie the documents of a long one to a centre.

    The centre is the document of the lowest hash, so long columns of much the same
    documents mostly have the same one.  A column may be cut over tasks' batches; of a long
    one only the centre is held.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
        long, centre = None, 0  # the long column at hand and its first document
        for b in batches:
            held = [np.concatenate([x, b.column(j).to_numpy()]) for j, x in enumerate(held)]
            if not len(held[0]):
                continue
            if long is not None:
                more = int(np.searchsorted(held[0], long, "right"))
                yield from _tied(centre, held[1][:more])
                held = [x[more:] for x in held]
                if not len(held[0]):
                    continue
            # the last column may go on in the next batch
            whole = int(np.searchsorted(held[0], held[0][-1]))
            yield from _multiply(*(x[:whole] for x in held), short)
            held = [x[whole:] for x in held]
            long = None
            if len(held[0]) > short:
                long, centre = held[0][0], int(held[1][0])
                yield from _tied(centre, held[1])
                held = [x[:0] for x in held]
        yield from _multiply(*held, short)

    return rows.repartition("h").sortWithinPartitions("h", F.xxhash64("k"), "k").mapInArrow(go, _PAIRS)


def _tied(centre: int, k: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows without sizes that tie the documents k of a long column to its centre."""
    k = np.unique(k[k != centre])
    if len(k):
        zero = np.zeros(len(k), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(k), centre), k, zero, zero, zero.astype(np.int64), zero, zero)], names=_PAIR_NAMES)


def _multiply(h: np.ndarray, k: np.ndarray, n: np.ndarray, i: np.ndarray, short: int) -> Iterator[pa.RecordBatch]:
    if not len(h):
        return
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    centre = k[first]
    by = np.lexsort((k, n, h))
    h, k, n, i = h[by], k[by], n[by], i[by]
    for s in np.unique(size[size > 1]):
        lists = first[size == s]
        if s > short:
            for at, c in zip(lists, centre[size == s], strict=True):
                yield from _tied(int(c), k[at : at + s])
            continue
        x, y = np.triu_indices(s, 1)
        step = max(1, 200_000 // len(x))
        for at in range(0, len(lists), step):
            p, q = ((lists[at : at + step, None] + z[None, :]).ravel() for z in (x, y))
            # n ascends in a column: n[p] <= n[q]
            after = np.minimum(n[p] - i[p], n[q] - i[q])
            ok = (BOTTOM * n[p].astype(np.int64) >= TOP * n[q].astype(np.int64)) & (np.minimum(i[p], i[q]) + after >= needed(n[p].astype(np.int64), n[q])) & (k[p] != k[q])
            p, q = p[ok], q[ok]
            flip = k[p] > k[q]
            p, q = np.where(flip, q, p), np.where(flip, p, q)
            yield from _summed(k[p], k[q], n[p], n[q], n[p] - i[p] - 1, n[q] - i[q] - 1)


def _summed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(a):
        return
    by = np.lexsort((b, a))
    a, b, na, nb, ra, rb = (x[by] for x in (a, b, na, nb, ra, rb))
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    c = np.diff(np.append(first, len(a)))
    yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(na[first], pa.int32()), pa.array(nb[first], pa.int32()), pa.array(c, pa.int64()), pa.array(np.minimum.reduceat(ra, first), pa.int32()), pa.array(np.minimum.reduceat(rb, first), pa.int32())], names=_PAIR_NAMES)


def mark(k: np.ndarray) -> np.ndarray:
    return (mix(k.view(np.uint64)) >> U(64 - MARK_BITS)).astype(np.int64)


def marks(keys: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of keys (k); its size is fixed, so it says no for sure and yes perhaps."""
    width = (1 << MARK_BITS) // CHUNKS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = mark(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(m // width), pa.array(m % width)], names=["chunk", "bit"])

    def fill(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(width, bool)
        for pdf in batches:
            bits[pdf["bit"].to_numpy()] = True
        yield pd.DataFrame({"chunk": [int(key[0])], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    out = np.zeros((CHUNKS, width // 8), np.uint8)
    for r in keys.select("k").mapInArrow(hashed, "chunk long, bit long").distinct().groupBy("chunk").applyInPandas(fill, "chunk long, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.ravel()


def sets_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(k, s): the n-gram set, 8 bytes a hash in order, of the documents of docs (k, text) that the bitmap marks, and of few others."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = mark(b.column("k").to_numpy())
            b = b.filter(pa.array((held.value[m >> 3] >> (7 - (m & 7)).astype(np.uint8)) & 1 == 1))
            for run in runs(arrow_strings(b, "text")):
                g, bounds = shingle_sets(run)
                s = [g[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("k").slice(run.first, len(s)), pa.array(s, pa.binary())], names=["k", "s"])

    return docs.mapInArrow(go, "k long, s binary").distinct()


def unpack(s: bytes) -> np.ndarray:
    return np.frombuffer(s, np.uint64)


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link; the bounds by size come before the sets are read."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(BOTTOM * both >= TOP * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # a document with many partners is there once for every BLOCK_DOCS of them
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("times"))
    firsts = sets.select(F.col("k").alias("a"), F.col("s").alias("sa")).join(many, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("times")).cast("int")).drop("times")
    full = dealt.join(firsts, ["a", "part"]).join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    fit = full.where(BOTTOM * F.least(F.octet_length("sa"), F.octet_length("sb")) >= TOP * F.greatest(F.octet_length("sa"), F.octet_length("sb")))
    return fit.select("a", "b", "sa", "sb").mapInArrow(go, "a long, b long")


def star_links(stars: DataFrame, sets: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Links (a, b) between different components inside stars (g, k, label): a spanning forest of each block pair's links.

    A component of half a block and more inside a star has blocks of its own, all others share
    blocks; blocks of one component are not multiplied with each other.  Stars of one
    component drop out as a whole.
    """
    sized = stars.join(sets.select("k", F.octet_length("s").alias("bytes")), "k")
    many = F.greatest(F.ceil(F.sum("docs") / block_docs), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    labels = written(sized.groupBy("g", "label").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes")), "labels")
    open_ = labels.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    big = F.when((2 * F.col("docs") >= block_docs) | (2 * F.col("bytes") >= BLOCK_BYTES), F.col("label"))
    labels = labels.join(open_, "g", "left_semi").withColumn("own", big)
    shared = labels.groupBy("g", "own").agg(many.alias("blocks"))
    placed = stars.join(labels.select("g", "label", "own"), ["g", "label"]).join(shared.select("g", F.col("own").alias("o"), "blocks"), ["g"]).where(F.col("own").eqNullSafe(F.col("o")))
    placed = written(placed.select("g", "k", F.struct("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("x")).alias("block")), "placed")
    blocks = placed.select("g", "block").distinct()
    # a row a pair of blocks, which are at least half full but for one a star
    across = blocks.select("g", F.col("block").alias("i")).join(blocks.select("g", F.col("block").alias("j")), "g").where("i <= j and (i.own is null or j.own is null or i.own <> j.own)")
    sides = across.select("g", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = placed.join(sides, ["g", "block"]).join(sets, "k").select("g", "i", "j", (F.col("block") != F.col("i")).alias("side"), "k", "s")

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        side = pdf["side"].to_numpy(bool)
        a, b = _product(pdf["k"].to_numpy(), [unpack(s) for s in pdf["s"]], side, bool(side.any()))
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy("g", "i", "j").applyInPandas(go, "a long, b long")


def _product(k: np.ndarray, sets: list[np.ndarray], side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (root, document), of the links among sets; with cross only of those between the two sides."""
    m = len(k)
    n = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    by = np.lexsort((owner, h))
    h, owner = h[by], owner[by]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    overlap = np.zeros((m, m), np.float32)
    flat = overlap.reshape(-1)
    for s in np.unique(size[(size > 1) & (size <= 16)]):
        x, y = np.triu_indices(s, 1)
        at = first[size == s]
        for lo in range(0, len(at), 20_000):
            p, q = (owner[(at[lo : lo + 20_000, None] + z[None, :]).ravel()] for z in (x, y))
            cell, count = np.unique(p * m + q, return_counts=True)
            flat[cell] += count
    wide = np.flatnonzero(size > 16)
    for lo in range(0, len(wide), 2048):
        w = wide[lo : lo + 2048]
        rows = np.concatenate([owner[first[c] : first[c] + size[c]] for c in w])
        dense = np.zeros((m, len(w)), np.float32)
        dense[rows, np.repeat(np.arange(len(w)), size[w])] = 1
        overlap += np.triu(dense @ dense.T, 1)
    p, q = np.nonzero(overlap)
    both = overlap[p, q].astype(np.int64)
    ok = (BOTTOM * both >= TOP * (n[p] + n[q] - both)) & (p < q)
    if cross:
        ok &= side[p] != side[q]
    p, q = p[ok], q[ok]
    label = np.arange(m)
    while True:  # smallest label over links
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(m))
    return k[label[moved]], k[moved]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", short: int = SHORT, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """key, n_shingles and component_id of every row of docs.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set holds the
    distinct n-grams of N words of the whole text, with fewer words the whole sequence.
    Texts link from a Jaccard similarity of TOP / BOTTOM on; component_id is the
    smallest key that links reach.  Texts without words have size 0 and are
    linked with nothing.  Keys are whole numbers; rows of one key are one node; rows
    without a key take part in no link and have no component.  Equal rows keep their
    count, an empty table gives no rows and other columns are left alone; a key named
    like a result, or not a whole number, is a ValueError.  Sets are compared by 64-bit
    hashes of their n-grams, classes by 128 bits.  `short` and `block_docs` change no result.
    """
    no_clash([key], ["n_shingles", "component_id"])
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} has to hold whole numbers")
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))
    seen = written(profile(slim), "profile")
    order = classes_of(sketch(seen))
    rows = seen.where("counts is null").select("k", "n", "f1", "f2")
    classes = written(rows.where("n > 0 and k is not null").groupBy("n", "f1", "f2").agg(F.min("k").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    nodes = written(spread_join(rows, classes, ["n", "f1", "f2"]).withColumn("rep", F.coalesce("rep", "k")).select("k", "n", "f1", "f2", "rep"), "nodes")
    others = nodes.where("k <> rep").select("k", "f1", "f2").distinct()
    have_key = slim.where("k is not null")
    packed = prefixes(have_key, order).join(others, ["k", "f1", "f2"], "left_anti")
    made = columns_to_pairs(entries(packed), short).groupBy("a", "b", (F.col("na") == 0).alias("tie")).agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c"), F.min("ra").alias("ra"), F.min("rb").alias("rb"))
    # what lies behind the prefix that ends first, or behind the last shared n-gram, may be shared as a whole
    behind = f"least(ra, rb, greatest(({TOP} * na + {BOTTOM - 1}) div {BOTTOM}, ({TOP} * nb + {BOTTOM - 1}) div {BOTTOM}) - 1)"
    made = written(made.where(f"tie or c + {behind} >= ceil({TOP} * (na + nb) / {TOP + BOTTOM})").select("a", "b", "tie"), "candidates")
    stars, pairs = made.where("tie"), made.where("not tie").select("a", "b")
    sets = written(sets_of(have_key, marks(made.select(F.explode(F.array("a", "b")).alias("k")).distinct())), "sets")
    # one partner a document, and the centres of its stars
    firsts = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct()
    firsts = written(firsts, "firsts")
    near = written(linked_pairs(firsts, sets), "links")
    label = components(near, "a", "b").withColumnsRenamed({"node": "k", "component": "label"})
    label = written(label, "labels")

    def labelled(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(label.select(F.col("k").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    rest = labelled(labelled(pairs.join(firsts, ["a", "b"], "left_anti"), "a", "la"), "b", "lb").where("la <> lb").select("a", "b")
    points = stars.select(F.col("a").alias("g"), F.col("b").alias("k")).union(stars.select("a", "a")).distinct()
    # rows of one key are one node, whatever their texts
    same = nodes.where("k is not null").groupBy("k").agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1").select(F.explode("reps").alias("b"), F.array_min("reps").alias("a")).select("a", "b")
    links = near.union(linked_pairs(rest, sets)).union(star_links(labelled(points, "k", "label"), sets, block_docs)).union(same)
    found = components(links, "a", "b")
    out = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("k").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("k").isNotNull(), F.coalesce("component", "rep")).cast(docs.schema[key].dataType).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that have the smallest key of their component; rows without a key stay."""
    found = near_duplicates(docs, key, text)
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    return docs.join(gone, key, "left_anti").select(*docs.columns)

