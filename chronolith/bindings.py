"""The engine's relations bound to a star schema: orders are commits, line items are changes, parts are files.

A part's key is its path; suppliers and parts make the finer paths.  Documents stand for source
texts, pages for files with imports, events for the edges of a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import author_key, month_of
from .operators import graph, history, scoring
from .sources import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _commit(o: DataFrame) -> DataFrame:
    date = F.to_date("o_orderdate")
    cust = F.col("o_custkey").cast("string")
    email = F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" U"), cust, F.lit("@X.org")))
    day = F.unix_date(date)
    return o.select(
        F.col("o_orderkey").alias("hash"), author_key(F.concat(F.lit("Customer "), cust), email).alias("key"), F.concat(F.lit("Customer "), cust).alias("name"),
        date.alias("date"), day.alias("day"), month_of(F.date_format(date, "yyyy-MM-dd")).alias("bucket"), (F.col("o_orderstatus") == "P").alias("merge"),
        F.col("o_orderpriority").alias("subject"), (-(day * F.lit(10_000_000_000) + F.col("o_orderkey"))).alias("seq"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with the number of their changes."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("hash")).agg(F.count("*").alias("n_files"))
    return _commit(table(spark, sf_dir, "orders")).join(n, "hash", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def plain_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commit(table(spark, sf_dir, "orders"))


def changes(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """Changes with the facts of their commit, from one written table: the join of items and orders is paid once."""
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    n = F.col("l_linenumber")

    def make() -> DataFrame:
        c = table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("hash"), part.alias("part"), supplier.alias("supplier"), F.col("l_quantity").cast("int").alias("add"), n.alias("del"), (n == 7).alias("binary"), (n == 6).alias("rename"),
        )
        return c.join(plain_commits(spark, sf_dir), "hash")

    c = scratch.once(spark, "changes", [table(spark, sf_dir, t) for t in ("orders", "lineitem")], make)
    path = F.concat(F.col("supplier"), F.lit("/"), F.col("part")) if fine else F.col("part")
    old = F.when(F.col("rename"), F.concat(F.lit("old/"), F.col("supplier"))).alias("old_path")
    return c.select("hash", path.alias("path"), "add", "del", "binary", "rename", old, *(x for x in c.columns if x not in ("hash", "part", "supplier", "add", "del", "binary", "rename")))


def raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw commit relation: a row an order with its changes in an array."""
    date, cust = F.to_date("o_orderdate"), F.col("o_custkey").cast("string")
    o = table(spark, sf_dir, "orders").select(
        (-(F.unix_date(date) * F.lit(10_000_000_000) + F.col("o_orderkey"))).alias("seq"), F.col("o_orderkey").cast("string").alias("hash"), F.concat(F.lit("Customer "), cust).alias("author"),
        F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" U"), cust, F.lit("@X.org"))).alias("email"), F.date_format(date, "yyyy-MM-dd").alias("date"),
        (F.col("o_orderstatus") == "P").alias("merge"), F.col("o_orderpriority").alias("subject"),
    )
    n = F.col("l_linenumber")
    change = F.struct(
        F.col("l_partkey").cast("string").alias("path"), F.when(n == 6, F.concat(F.lit("old/"), F.col("l_suppkey").cast("string"))).alias("old_path"), F.col("l_quantity").cast("int").alias("add"),
        n.cast("int").alias("del"), (n == 7).alias("binary"), (n == 6).alias("rename"),
    )
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("hash")).agg(F.collect_list(change).alias("files"))
    return o.join(files, "hash", "left")


def today(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    """The newest commit's date, a scalar of the orders."""
    orders = table(spark, sf_dir, "orders")
    newest = scratch.once(spark, "newest", [orders], lambda: orders.agg(F.to_date(F.max("o_orderdate")).alias("d")))
    return F.lit(newest.first()[0])


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("path"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each part as a file: sizes come from its attributes, every seventh is a test, every eleventh generated."""
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    return p.select(
        k.cast("string").alias("rel"), F.concat_ws("/", "p_brand", "p_type").alias("dir"), F.col("p_brand").alias("language"), (s * 10).cast("long").alias("code"), (s % 4).cast("long").alias("comment"),
        (s % 3).cast("long").alias("blank"), (s * 10 + s % 4 + s % 3).cast("long").alias("total"), (s % 9).cast("long").alias("decisions"), (s * 100).cast("long").alias("bytes"),
        (s % 13).cast("long").alias("complexity"), (s % 5).cast("long").alias("funcs"), (k % 4).cast("long").alias("debt"), (k % 4 * 2).cast("long").alias("debt_weight"), (k % 3).cast("long").alias("suppressed"),
        (k % 7 == 0).alias("is_test"), (k % 11 == 0).alias("is_generated"),
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from returned parts to the part of the supplier's number."""
    e = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_partkey <> l_suppkey")
    return e.select(F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst")).distinct()


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the user to `k` of every error event."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("src"), k.alias("dst")).where("src <> dst").distinct()


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of all parts, one written table that every score and ranking reads."""

    def make() -> DataFrame:
        ch = changes(spark, sf_dir)
        e = scratch.written(part_edges(spark, sf_dir), "edges")
        s = shapes(spark, sf_dir)
        tests = s.where("is_test").select(F.col("rel").alias("src"))
        tested = e.join(tests, "src", "left_semi").select(F.col("dst").alias("rel")).distinct()
        in_cycle = graph.cycles(event_edges(spark, sf_dir)).select(F.col("node").cast("string").alias("rel"))
        return scoring.signals(s, history.file_history(ch), history.ownership(history.file_author(ch)), graph.fan_in(e), graph.fan_out(e), tested, in_cycle, today(spark, sf_dir))

    return scratch.once(spark, "signals", [table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "events")], make)
