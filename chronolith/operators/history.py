"""History aggregates over commits and changes.

A commits frame has (hash, key, name, date, day, bucket, merge, subject, seq) and a changes
frame the same columns with path, add, del, binary, rename and old_path; `prepare` makes both
from the raw commit relation.  seq is 0 for the newest commit, which is seen first.
All aggregates are mergeable (sums, counts, minima, maxima), so they combine before the shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import author_key, basename, day_index, extension, month_of, parent


#: Pairs of a commit's new and old paths that are tried one by one at most.
DIRECT = 10_000


def prepare(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of the raw relation with author keys, days and month buckets."""
    c = commits.select(
        "seq", "hash", author_key(F.col("author"), F.col("email")).alias("key"), F.col("author").alias("name"), "date",
        day_index(F.col("date")).alias("day"), month_of(F.col("date")).alias("bucket"), "merge", "subject", "files",
    )
    return c.withColumn("n_files", F.size("files")).drop("files"), c.select("*", F.inline("files")).drop("files")


def window(commits: DataFrame, since: str | None = None, until: str | None = None, max_count: int | None = None, path_like: str | None = None) -> DataFrame:
    """The commits of a window: date bounds, a number of the newest, commits that touch a path."""
    if since:
        commits = commits.where(F.col("date") >= since)
    if until:
        commits = commits.where(F.col("date") <= until)
    if path_like:
        commits = commits.where(F.exists("files", lambda f: f["path"].rlike(path_like)))
    return commits.orderBy("seq").limit(max_count) if max_count else commits


def _lines(flag: str) -> Column:
    return F.coalesce(F.sum(F.when(~F.coalesce(F.col("binary"), F.lit(False)), F.greatest(F.col(flag), F.lit(0)))), F.lit(0)).cast("long")


def _dated(agg: Column) -> Column:
    return F.coalesce(agg, F.lit(0)).cast("int")


def _first_day() -> Column:
    return _dated(F.min(F.when(F.col("day") > 0, F.col("day"))))


def _last_day() -> Column:
    return _dated(F.max("day"))


def summary(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: commits, merges, empty and authored commits, day span, lines, binary changes, renames."""
    c = commits.agg(
        F.count("*").alias("commits"), F.count_if("merge").alias("merges"), F.count_if(F.col("n_files") == 0).alias("empty_commits"),
        F.count("*").alias("authored_commits"), F.countDistinct("key").alias("authors"), _first_day().alias("oldest_day"), _last_day().alias("newest_day"),
    )
    f = changes.agg(_lines("add").alias("adds"), _lines("del").alias("dels"), F.count_if("binary").alias("binary_changes"), F.count_if(F.col("rename") & F.col("old_path").isNotNull()).alias("renames"))
    return c.crossJoin(F.broadcast(f))  # one row each


def file_history(changes: DataFrame) -> DataFrame:
    """Per path: commits, lines, days, and the extremes by day; of one day the first seen is born, the last seen is last."""
    dated = F.col("day") > 0
    return changes.groupBy("path").agg(
        F.count("*").alias("commits"), _lines("add").alias("adds"), _lines("del").alias("dels"), _first_day().alias("first_day"), _last_day().alias("last_day"),
        F.bool_or(F.coalesce("binary", F.lit(False))).alias("binary"),
        F.min(F.when(dated, F.struct("day", "seq", "hash")))["hash"].alias("born_commit"),
        F.max(F.when(dated, F.struct("day", "seq", "key", "subject"))).alias("last"),
        F.min(F.when(F.col("rename") & F.col("old_path").isNotNull(), F.struct("seq", "old_path")))["old_path"].alias("merged_into"),
        F.min("seq").alias("first_seq"),
    ).select("*", F.col("last.key").alias("last_author"), F.col("last.subject").alias("last_subject")).drop("last")


def file_author(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path", "key").agg(F.count("*").alias("n"))


def file_month(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path", "bucket").agg(F.count("*").alias("n"))


def author_activity(commits: DataFrame) -> DataFrame:
    """Per author: commits, merges, days, active months, the name seen first."""
    return commits.groupBy("key").agg(
        F.min(F.struct("seq", "name"))["name"].alias("name"), F.count("*").alias("commits"), F.count_if("merge").alias("merges"),
        _first_day().alias("first_day"), _last_day().alias("last_day"), F.countDistinct("bucket").alias("active_months"), F.min("seq").alias("first_seq"),
    )


def month_activity(commits: DataFrame) -> DataFrame:
    return commits.groupBy("bucket").agg(F.count("*").alias("commits"), F.count_if("merge").alias("merges"), F.countDistinct("key").alias("authors"))


def line_churn(changes: DataFrame, by: str) -> DataFrame:
    """Lines added and deleted by `by` (path, key or bucket)."""
    return changes.groupBy(by).agg(_lines("add").alias("adds"), _lines("del").alias("dels"))


def distinct_files(pairs: DataFrame, by: str) -> DataFrame:
    """Files that each author or month touched, from the long tables: a second aggregate in place of a distinct count."""
    return pairs.groupBy(by).agg(F.count("*").alias("files"))


def ownership(pairs: DataFrame) -> DataFrame:
    """Per path: number of authors and the sum of squared shares of its commits."""
    return pairs.groupBy("path").agg(F.count("*").alias("authors"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"))


def deleted(history: DataFrame, present: DataFrame) -> DataFrame:
    """Paths of the history that are not present (path)."""
    return history.join(present.select("path"), "path", "left_anti")


def rename_score(old: Column, new: Column) -> Column:
    a, b = basename(old), basename(new)
    name = F.when(a == b, 100).when(F.startswith(a, b) | F.startswith(b, a), 20).otherwise(0)
    return name + F.when(extension(old) == extension(new), 10).otherwise(0) + F.when(parent(old) == parent(new), 5).otherwise(0)


def rename_matches(history: DataFrame, present: DataFrame) -> DataFrame:
    """(path, inferred_from): present paths paired with vanished ones of the same birth commit.

    Present paths choose in the order in which they were first seen, each the best
    candidate of at least 20 points that is left; of equal ones the one seen first.
    Twenty points ask for base names of which one begins the other.  In commits of at
    most DIRECT pairs all are tried; in larger ones pairs come from equi-joins of the names
    with each other's beginnings.  The greedy step runs a commit at a time.
    """
    kept = present.select("path").distinct().withColumn("here", F.lit(True))
    born = history.where("born_commit is not null").select("path", "born_commit", "first_seq").join(kept, "path", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    sizes = born.groupBy("born_commit").agg((F.count_if("here") * F.count_if(~F.col("here"))).alias("tries")).where("tries > 0")
    born = born.join(sizes, "born_commit").withColumn("name", basename(F.col("path")))
    here = born.where("here").select(F.col("path").alias("new"), "born_commit", F.col("first_seq").alias("new_seq"), "name", "tries")
    gone = born.where("not here").select(F.col("path").alias("old"), "born_commit", F.col("first_seq").alias("old_seq"), "name", "tries")
    direct = here.where(F.col("tries") <= DIRECT).drop("name", "tries").join(gone.where(F.col("tries") <= DIRECT).drop("name", "tries"), "born_commit")
    here, gone = (x.where((F.col("tries") > DIRECT) & (F.col("name") != "")).drop("tries") for x in (here, gone))
    begun = F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n)))
    longer = here.withColumn("name", begun).join(gone, ["born_commit", "name"]).drop("name")
    shorter = here.join(gone.withColumn("name", begun), ["born_commit", "name"]).drop("name")
    pairs = direct.unionByName(longer.unionByName(shorter).distinct()).withColumn("score", rename_score(F.col("old"), F.col("new"))).where("score >= 20")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, used, done = [], set(), set()
        for x in pdf.sort_values(["new_seq", "new", "score", "old_seq", "old"], ascending=[True, True, False, True, True]).itertuples():
            if x.new not in done and x.old not in used:
                done.add(x.new)
                used.add(x.old)
                rows.append((x.new, x.old))
        return pd.DataFrame(rows, columns=["path", "inferred_from"])

    return pairs.groupBy("born_commit").applyInPandas(choose, "path string, inferred_from string")


def fold(pairs: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """A long table (path, by, n) with the counts of matched old paths added to the new ones; old paths keep their own."""
    moved = pairs.join(matches.select(F.col("inferred_from").alias("path"), F.col("path").alias("to")), "path").select(F.col("to").alias("path"), by, "n")
    return pairs.select("path", by, "n").unionByName(moved).groupBy("path", by).agg(F.sum("n").alias("n"))


def fold_history(history: DataFrame, matches: DataFrame) -> DataFrame:
    """history with commits and lines of matched old paths added, and inferred_from."""
    sums = ("commits", "adds", "dels")
    moved = history.join(matches.select(F.col("inferred_from").alias("path"), F.col("path").alias("to")), "path").select(F.col("to").alias("path"), *(F.col(c).alias(f"old_{c}") for c in sums))
    out = history.join(moved, "path", "left").join(matches, "path", "left")
    return out.select(*(c for c in history.columns if c not in sums), *((F.col(c) + F.coalesce(f"old_{c}", F.lit(0))).alias(c) for c in sums), "inferred_from")


def head(commits: DataFrame) -> DataFrame:
    """The newest commit."""
    return commits.orderBy("seq").limit(1)


def shortlog(commits: DataFrame) -> DataFrame:
    """Commits of each name and address without merges."""
    return commits.where(~F.col("merge")).groupBy("author", "email").agg(F.count("*").alias("commits"))

