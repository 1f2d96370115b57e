"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, no_clash, ordered, small, written

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target words of each source from (source, source_size, n): one row a source.

    Sources are taken by code point, null last; their weights repeat.  `share` times all
    words are dealt out by weight, a source getting `most` times its own words at most:
    target = min(most * size, level * weight), where sources that are full give their
    excess to the others.  In the order of (most * size / weight) the full sources come
    first, so one pass of running sums finds the level.
    """
    # one row a source: these windows sort the table of sources, never documents
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({
        "sum_all": F.sum("source_size").over(everything) * F.lit(float(share)),
        "cap_before": F.sum("cap").over(to_here) - F.col("cap"),
        "w_from": F.sum("w").over(everything) - F.sum("w").over(to_here) + F.col("w"),
    })
    # the first source that the level of the rest does not fill; if there is none all are full
    level = F.greatest(F.col("sum_all") - F.col("cap_before"), F.lit(0.0)) / F.col("w_from")
    s = s.withColumn("level", F.min(F.when(level < F.col("fill"), F.struct("fill", level.alias("level")))).over(everything)["level"])
    return s.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Copies of each row in a mix of all sources: columns key, source, size, source_size, target, copies and row (struct of `keep`).

    A row's size is its number of words (null text: 0).  In every source each row is
    expected target / source_size times.  Rows are ordered by source, size and a hash of
    the key and dealt out by range; the prefix sum of expected copies plus one random
    offset of the source (from the seed and its name) is cut at integers, and a row is
    emitted once for each integer that its step crosses.  As `most` bounds the
    expectation, no row is taken more than ceil(most) times, and because rows stand in
    order of size the words taken differ from the target by one row's size at most.

    Null sources form one source, null keys sort first and equal rows count one by one.
    Sources without words have target 0 and no copies.  An empty table gives no rows.
    Columns in `keep` may have any names; a key named like a result is a ValueError.
    """
    no_clash([key], ["source", "size", "source_size", "target", "copies", "row"])
    keep_row = [F.struct(*keep).alias("row")] if keep else []
    slim = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep_row)
    if not keep:
        slim = written(slim, "sizes")  # narrow, and read twice
    rows = ordered(slim.withColumn("tie", F.xxhash64("k", F.lit(seed))), [F.col("source").asc_nulls_last(), F.col("size"), F.col("tie"), F.col("k")], "size")
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("ord").alias("first")))
    n_sources = sizes.count()
    goals = source_targets(sizes.select("source", "source_size", "n"), weights, share, most).withColumnRenamed("source", "s")
    goals = goals.join(sizes.select(F.col("source").alias("s0"), "first"), F.col("s").eqNullSafe(F.col("s0"))).drop("s0", "n")
    out = rows.join(small(goals, n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))

    def crossed(i: Column) -> Column:
        return F.floor(i.cast("double") * F.col("rate") + F.col("offset"))

    out = out.withColumn("rate", rate).withColumn("offset", offset).withColumn("i", F.col("ord") - F.col("first"))
    out = out.withColumn("copies", (crossed(F.col("i") + 1) - crossed(F.col("i"))).cast("int"))
    return out.select(F.col("k").alias(key), "source", "size", "source_size", "target", "copies", *(["row"] if keep else []))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: all columns of docs, each row as many times as it is taken."""
    taken = mix(docs, keep=tuple(docs.columns), **options)
    return taken.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
