"""Rankings and ordered computations over history and signals.  Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import activity


def bus_factor(authors: DataFrame, share: float = 0.5) -> DataFrame:
    """(bus_factor): the fewest authors, most commits first, with `share` of all commits; 0 without authors.

    Authors with one number of commits are counted before they are ordered, so the running
    sum goes over distinct numbers, not over authors.
    """
    steps = authors.groupBy("commits").agg(F.count("*").alias("m"))
    w = Window.orderBy(F.desc("commits"))
    s = steps.select("commits", "m", (F.sum(F.col("commits") * F.col("m")).over(w) - F.col("commits") * F.col("m")).alias("before"), (F.sum("m").over(w) - F.col("m")).alias("people"))
    total = authors.agg(F.coalesce(F.sum("commits"), F.lit(0)).alias("total"))
    need = F.col("total") * F.lit(share) - F.col("before")
    here = F.when((need > 0) & (need <= F.col("commits") * F.col("m")), F.col("people") + F.ceil(need / F.col("commits")))
    return s.crossJoin(F.broadcast(total)).agg(F.coalesce(F.max(here), F.lit(0)).cast("long").alias("bus_factor"))


def churn_concentration(signals: DataFrame, top: float = 0.1) -> DataFrame:
    """(files, top_files, share): commits that the most changed tenth of the files made."""
    w = Window.orderBy(F.desc("commits"))
    steps = signals.where("commits > 0").groupBy("commits").agg(F.count("*").alias("m"))
    s = steps.select("commits", "m", (F.sum("m").over(w) - F.col("m")).alias("before"))
    all_ = steps.agg(F.sum("m").alias("files"), F.sum(F.col("m") * F.col("commits")).alias("total")).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("files") * top)))
    taken = F.greatest(F.lit(0), F.least(F.col("m"), F.col("k") - F.col("before")))
    return s.crossJoin(F.broadcast(all_)).agg(F.coalesce(F.max("files"), F.lit(0)).alias("files"), F.coalesce(F.max("k"), F.lit(0)).alias("top_files"), F.coalesce(F.sum(taken * F.col("commits")) / F.max("total"), F.lit(0.0)).alias("share"))


def percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """(value): the element at floor(p * (n - 1)) of the sorted values, without interpolation."""
    steps = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("m"))
    w = Window.orderBy(value)
    s = steps.select(value, F.sum("m").over(w).alias("upto"))
    n = steps.agg(F.sum("m").alias("n"))
    return s.crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1))).agg(F.min(value).alias("value"))


def timeline(months: DataFrame, today: Column, length: int = 26) -> DataFrame:
    """The last `length` calendar months up to today's, oldest first (ord), with zeros where months has no row."""
    spark = months.sparkSession
    spine = spark.range(1).select(F.posexplode(F.sequence(F.add_months(F.trunc(today, "month"), -(length - 1)), F.trunc(today, "month"), F.expr("interval 1 month"))).alias("ord", "d")).select("ord", F.date_format("d", "yyyy-MM").alias("month"))
    values = [c for c in months.columns if c != "bucket"]
    return F.broadcast(spine).join(months.withColumnRenamed("bucket", "month"), "month", "left").select("ord", "month", *(F.coalesce(c, F.lit(0)).alias(c) for c in values))


def cadence(line: DataFrame, last: int = 6) -> DataFrame:
    """(active_months, cadence): months with commits among the last ones of a timeline."""
    recent = line.orderBy(F.desc("ord")).limit(last)
    return recent.agg(F.count_if(F.col("commits") > 0).alias("active_months")).withColumn("cadence", F.col("active_months") / last)


def peak(line: DataFrame) -> DataFrame:
    """(month, commits): the first month with the most commits."""
    return line.agg(F.max(F.struct("commits", -F.col("ord"), "month")).alias("x")).select("x.month", "x.commits")


def downsample(line: DataFrame, ord_: str, value: str, bucket: int) -> DataFrame:
    return line.groupBy(F.floor(F.col(ord_) / bucket).alias("bucket")).agg(F.max(value).alias(value))


def author_rank(authors: DataFrame, today: Column) -> DataFrame:
    """Authors with tenure, days since the last commit, activity label and share of all commits."""
    total = authors.agg(F.sum("commits").alias("total"))
    since = F.unix_date(today) - F.col("last_day")
    return authors.crossJoin(F.broadcast(total)).select("*", (F.col("commits") - F.col("merges")).alias("non_merge"), F.when(F.col("first_day") > 0, F.col("last_day") - F.col("first_day")).otherwise(0).alias("tenure_days"), since.alias("last_active"), activity(since).alias("label"), (F.col("commits") / F.col("total")).alias("share")).drop("total")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order; a limited sort keeps k rows a task."""
    return df.orderBy(*order).limit(k)


def single_owner(signals: DataFrame) -> DataFrame:
    return signals.where("rankable and commits >= 2 and authors = 1")


def orphans(signals: DataFrame, k: int = 20) -> DataFrame:
    return top(signals.where("not is_test and commits = 0 and code > 0"), k, F.desc("code"), F.col("rel"))


def stale(signals: DataFrame, k: int = 20, days: int = 365, code: int = 200) -> DataFrame:
    return top(signals.where(f"rankable and days_since > {days} and code > {code}"), k, F.desc("code"), F.col("rel"))


def untested_hot(hotspots: DataFrame, k: int = 6) -> DataFrame:
    return top(hotspots.where("not is_tested and not is_test and commits > 3"), k, F.desc("risk"), F.col("rel"))


def search_files(files: DataFrame, needle: str) -> DataFrame:
    return files.where(F.contains(F.lower("rel"), F.lit(needle.lower())))


def search_authors(authors: DataFrame, needle: str) -> DataFrame:
    return authors.where(F.contains(F.lower("name"), F.lit(needle.lower())) | F.contains(F.col("key"), F.lit(needle.lower())))
