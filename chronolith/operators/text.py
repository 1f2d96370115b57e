"""Text measures as built-in expressions, and roll-ups of file shapes.

The expressions work on plain text columns and stay inside code generation; the exact
lexer of source files is functions.lexer.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..registry import DEFINITION_CAP, MAX_BYTES, OPERATOR_SHARE_CAP, keyword_pattern


def _long(c: Column) -> Column:
    return c.cast("long")


def line_census(text: Column, comment: str | None = None) -> Column:
    """struct(total, code, comment, blank) of the lines of a text; a line is comment if it begins with `comment`."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1)
    lines = F.when(t == "", F.array().cast("array<string>")).otherwise(lines)
    blank = F.size(F.filter(lines, lambda s: s.rlike(r"^\s*$")))
    said = F.size(F.filter(lines, lambda s: F.startswith(F.trim(s), F.lit(comment)))) if comment else F.lit(0)
    return F.struct(_long(F.size(lines)).alias("total"), _long(F.size(lines) - blank - said).alias("code"), _long(said).alias("comment"), _long(blank).alias("blank"))


def operator_decisions(text: Column) -> Column:
    return _long(F.regexp_count(text, F.lit(r"\?(?!:)|&&|\|\|")))


def keyword_decisions(text: Column, words: Sequence[str]) -> Column:
    """Occurrences of the words, each counted on its own."""
    total = F.lit(0)
    for w in words:
        total = total + F.regexp_count(text, F.lit(keyword_pattern(w)))
    return _long(total)


def total_decisions(keywords: Column, operators: Column) -> Column:
    return keywords + F.least(F.lit(OPERATOR_SHARE_CAP), F.shiftright(operators.cast("int"), 4))


def definitions(text: Column, patterns: Sequence[str]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(p))
    return _long(F.least(F.lit(DEFINITION_CAP), total))


def nesting_depth(text: Column) -> Column:
    """Greatest bracket depth; closing brackets stop at the ground."""
    marks = F.regexp_extract_all(text, F.lit(r"[{}()\[\]]"), 0)
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a: Column, c: Column) -> Column:
        d = F.when(c.isin("{", "(", "["), a["d"] + 1).otherwise(F.greatest(F.lit(0), a["d"] - 1))
        return F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m"))

    return _long(F.aggregate(marks, start, step)["m"])


def comments(text: Column, opening: str, closing: str) -> Column:
    """Array of the comments between two marks."""
    return F.regexp_extract_all(text, F.lit(rf"(?s){opening}.*?{closing}"), 0)


def import_specs(files: DataFrame, key: str, text: str, pattern: str, group: int = 1) -> DataFrame:
    """(key, spec): distinct pieces of a pattern's group, split at commas and without ` as x`."""
    found = files.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), group)).alias("m"))
    pieces = found.select(key, F.explode(F.split("m", ",")).alias("p"))
    return pieces.select(key, F.regexp_replace(F.trim("p"), r"(?s)\s+as\s+.*$", "").alias("spec")).where("spec <> ''").distinct()


def marker_rows(files: DataFrame, key: str, text: str, weights: Mapping[str, int]) -> DataFrame:
    """(key, line, marker, weight, text, n): a row for each label that an upper-cased line holds, with its occurrences n."""
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct((i + 1).alias("line"), s.alias("body"), F.upper(s).alias("up")))
    # lines without any label are never rows
    said = F.filter(lines, lambda x: x["up"].rlike("|".join(re.escape(m) for m in weights)))
    marks = F.array(*(F.struct(F.lit(m).alias("marker"), F.lit(w).alias("weight"), F.lit(len(m)).alias("size")) for m, w in weights.items()))
    rows = files.select(key, F.inline(said)).select(key, "line", "body", "up", F.inline(marks))
    n = (F.length("up") - F.length(F.replace(F.col("up"), F.col("marker"), F.lit("")))) / F.col("size")
    return rows.withColumn("n", n.cast("int")).where("n > 0").select(key, "line", "marker", "weight", F.substring(F.trim("body"), 1, 90).alias("text"), "n")


def marker_counts(markers: DataFrame, key: str) -> DataFrame:
    """Per marker: count, weight and distinct files; without a column n a row is one occurrence."""
    n = F.col("n") if "n" in markers.columns else F.lit(1)
    return markers.groupBy("marker").agg(F.sum(n).cast("long").alias("count"), F.sum(F.col("weight") * n).cast("long").alias("weight"), F.countDistinct(key).alias("files"))


def oldest_marker(markers: DataFrame, signals: DataFrame) -> DataFrame:
    """The marker of weight 2 and more in the file untouched longest; of equal ones by path, weight and line."""
    m = markers.where("weight >= 2").join(signals.where("days_since is not null").select("rel", "days_since", "code"), "rel")
    return m.orderBy(F.desc("days_since"), "rel", F.desc("weight"), "line", "marker").limit(1)


def classify(paths: DataFrame, exclude: Sequence[str] = (), rel: str = "rel", size: str = "size", max_bytes: int = MAX_BYTES) -> DataFrame:
    """paths with language, test, vendor, generated and skip: excluded, vendor, binary, missing, other, empty, large or null (kept), in that order.

    size is null for missing and negative for other than regular files.
    """
    p, n = F.col(rel), F.col(size)
    skip = (
        F.when(X.is_excluded(p, exclude), "excluded").when(X.is_vendor(p), "vendor").when(X.is_binary_name(p), "binary").when(n.isNull(), "missing").when(n < 0, "other").when(n == 0, "empty").when(n > max_bytes, "large")
    )
    language = X.language_for(p)
    return paths.withColumns({"language": language, "test": X.is_test(p, language), "vendor": X.is_vendor(p), "generated": X.is_generated(p), "skip": skip})


def skip_histogram(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("skip", F.lit("kept")).alias("skip")).agg(F.count("*").alias("n"))


_SUMS = ("code", "comment", "blank", "total", "decisions", "bytes", "debt", "suppressed")


def language_rollup(files: DataFrame) -> DataFrame:
    """Totals by language and, with language null, of all: one aggregation for both levels."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _SUMS]
    out = files.rollup("language").agg(F.grouping("language").alias("all"), F.count("*").alias("files"), F.count_if("test").alias("test_files"), F.count_if(~F.col("test")).alias("source_files"), *sums, F.min("rel").alias("first_rel"))
    return out
