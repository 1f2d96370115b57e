"""Signals, the risk score and the health index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, grade, js_round, normalize
from ..registry import GRADES, RISK_WEIGHTS

MAXIMA = ("commits", "complexity", "per_function", "code", "debt_weight", "suppressed", "fan_in")


def signals(shapes: DataFrame, history: DataFrame, owners: DataFrame, fan_in: DataFrame, fan_out: DataFrame, tested: DataFrame, in_cycle: DataFrame, today: Column) -> DataFrame:
    """One row a file with all facts; shapes has rel, code, complexity, funcs, debt, debt_weight, suppressed, is_test, is_generated.

    All sides are joined on rel, so after the first join no side but the new one is shuffled.
    """
    h = history.select(F.col("path").alias("rel"), "commits", "first_day", "last_day", "last_author")
    o = owners.select(F.col("path").alias("rel"), "authors", "hhi")
    s = shapes.join(h, "rel", "left").join(o, "rel", "left").join(fan_in, "rel", "left").join(fan_out, "rel", "left")
    s = s.join(tested.select("rel", F.lit(True).alias("is_tested")), "rel", "left").join(in_cycle.select("rel", F.lit(True).alias("in_cycle")), "rel", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("commits", "authors", "fan_in", "fan_out", "first_day", "last_day")}
    s = s.withColumns({**zero, "hhi": F.coalesce("hhi", F.lit(0.0)), "is_tested": F.coalesce("is_tested", F.lit(False)), "in_cycle": F.coalesce("in_cycle", F.lit(False))})
    return s.withColumns({
        "per_function": F.col("complexity") / F.greatest(F.lit(1), F.col("funcs")),
        "days_since": F.when(F.col("last_day") > 0, F.unix_date(today) - F.col("last_day")),
        "rankable": ~F.col("is_test") & ~F.col("is_generated") & (F.col("code") > 0),
    })


def maxima(s: DataFrame) -> DataFrame:
    return s.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(f"max_{c}") for c in MAXIMA))


def parts(s: DataFrame) -> DataFrame:
    """s with the eight parts of risk; maxima are over all files and joined as one row."""

    def n(c: str) -> Column:
        return normalize(F.col(c), F.col(f"max_{c}"))

    out = s.crossJoin(F.broadcast(maxima(s)))
    out = out.withColumns({
        "churn": n("commits"),
        "complexity_part": n("complexity") * 0.5 + n("per_function") * 0.5,
        "size": n("code"),
        "debt_part": n("debt_weight"),
        "ownership": F.when(F.col("commits") > 0, F.col("hhi")).otherwise(0.0),
        "blast_radius": n("fan_in"),
        "untested": F.when(F.col("is_test") | F.col("is_generated") | F.col("is_tested"), 0.0).when(F.col("commits") > 0, 1.0).otherwise(0.35),
        "suppression": n("suppressed"),
    })
    return out.drop(*(f"max_{c}" for c in MAXIMA))


PART_OF = {"churn": "churn", "complexity": "complexity_part", "size": "size", "debt": "debt_part", "ownership": "ownership", "blastRadius": "blast_radius", "untested": "untested", "suppression": "suppression"}


def risk(s: DataFrame) -> DataFrame:
    """s with its parts, risk (0..100) and reasons: contributions of 3 and more, the largest first, equal ones in the order of the weights."""
    p = parts(s)
    terms = [(k, F.col(PART_OF[k]) * w * 100) for k, w in RISK_WEIGHTS.items()]
    total = terms[0][1]
    for _, t in terms[1:]:
        total = total + t
    rows = F.array(*(F.struct((-t).alias("minus"), F.lit(i).alias("i"), F.lit(k).alias("key"), t.alias("contribution")) for i, (k, t) in enumerate(terms)))
    reasons = F.transform(F.array_sort(F.filter(rows, lambda r: r["contribution"] >= 3)), lambda r: F.struct(r["key"].alias("key"), r["contribution"].alias("contribution")))
    return p.withColumn("risk", F.least(F.lit(100.0), total)).withColumn("reasons", reasons)


def hotspots(scored: DataFrame, k: int = 20) -> DataFrame:
    return scored.where("rankable").orderBy(F.desc("risk"), "rel").limit(k)


def owner_label(files: DataFrame, authors: DataFrame) -> DataFrame:
    """files (authors, last_author) with owner: the name of a single author (of authors: key, name), the number of several, `-` without any."""
    named = files.join(authors.select(F.col("key").alias("last_author"), F.col("name").alias("owner_name")), "last_author", "left")
    label = F.when(F.col("authors") <= 0, "-").when(F.col("authors") == 1, F.coalesce("owner_name", F.lit("unknown"))).otherwise(F.concat(F.col("authors").cast("string"), F.lit(" people")))
    return named.withColumn("owner", label).drop("owner_name")


def health(facts: DataFrame) -> DataFrame:
    """(key, value) of the seven components and the index, from one row of facts.

    facts: median_per_function, test_ratio, authors, active_authors, debt, code, cyclic_files, files, churn_share, active_months.
    """
    f = F.col
    ownership = F.when(f("authors") == 0, 1.0).otherwise(F.least(F.lit(1.0), f("active_authors") / F.greatest(F.lit(2.0), f("authors") * 0.25)))
    per_kloc = F.when(f("code") == 0, 0.0).otherwise(f("debt") / (f("code") / 1000))
    cyclic = F.when(f("files") == 0, 0.0).otherwise(f("cyclic_files") / f("files"))
    scores = {
        "maintainability": 1 - clamp((f("median_per_function") - 2) / 10),
        "tests": F.least(F.lit(1.0), f("test_ratio") * 1.6),
        "ownership": ownership,
        "debt": 1 - F.least(F.lit(1.0), per_kloc / 20),
        "structure": 1 - F.least(F.lit(1.0), cyclic * 8),
        "focus": 1 - clamp((f("churn_share") - 0.3) / 0.4),
        "velocity": f("active_months") / 6,
    }
    return facts.select(F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), js_round(v * 100).cast("long").alias("value")) for i, (k, v) in enumerate(scores.items())))).alias("x")).select("x.*")


def index(components: DataFrame) -> DataFrame:
    """(value, grade): the mean of the rounded components; the grade is of the mean before rounding."""
    return components.agg(F.avg("value").alias("m")).select(js_round(F.col("m")).cast("long").alias("value"), grade(F.col("m")).alias("grade"))


def fails(index_: DataFrame, threshold: str) -> DataFrame:
    """(failed): whether the grade is the threshold or worse."""
    letters = [*(g for _, g in GRADES), "E"]
    return index_.select((F.array_position(F.array(*map(F.lit, letters)), F.col("grade")) >= letters.index(threshold) + 1).alias("failed"))
