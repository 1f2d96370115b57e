"""Registered queries: the operators over the bound relations; their SQL is in `oracle`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from . import oracle_samples, samples
from .functions import exprs as X
from .operators import coverage, graph, history, rankings, scoring, text
from .oracle import SQL
from .sources import cache, scratch
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def query(f: Query) -> Query:
    _registered[f.__name__] = f
    return f


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


# ---- history


@query
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.summary(B.commits(spark, sf_dir), B.changes(spark, sf_dir))


@query
def file_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.file_history(B.changes(spark, sf_dir)).select("path", "commits", "adds", "dels", "first_day", "last_day", "binary")


@query
def file_birth_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.file_history(B.changes(spark, sf_dir, fine=True)).select("path", "born_commit", "last_author", "last_subject", "merged_into")


@query
def file_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.file_author(B.changes(spark, sf_dir))


@query
def file_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.file_month(B.changes(spark, sf_dir))


@query
def author_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.author_activity(B.plain_commits(spark, sf_dir)).drop("first_seq")


@query
def month_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.month_activity(B.plain_commits(spark, sf_dir))


@query
def author_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.distinct_files(history.file_author(B.changes(spark, sf_dir)), "key")


@query
def month_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.distinct_files(history.file_month(B.changes(spark, sf_dir)), "bucket")


@query
def file_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ownership(history.file_author(B.changes(spark, sf_dir))).select("path", "authors", *r6("hhi"))


@query
def empty_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.commits(spark, sf_dir).where("n_files = 0").select("hash", "bucket")


@query
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.window(B.plain_commits(spark, sf_dir), "1996-01-01", "1998-06-30", 500).select("hash", "key", "bucket")


@query
def line_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.line_churn(B.changes(spark, sf_dir), "bucket")


@query
def shortlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.plain_commits(spark, sf_dir).withColumnsRenamed({"name": "author", "key": "email"})
    return history.shortlog(c)


# ---- rankings


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.author_activity(B.plain_commits(spark, sf_dir))


@query
def bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.bus_factor(_authors(spark, sf_dir))


@query
def churn_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rankings.churn_concentration(history.file_history(B.changes(spark, sf_dir, fine=True)))
    return out.select("files", F.col("top_files").cast("long").alias("top_files"), *r6("share"))


@query
def single_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = B.changes(spark, sf_dir, fine=True)
    s = history.file_history(ch).join(history.ownership(history.file_author(ch)), "path").withColumn("rankable", F.lit(True))
    return rankings.single_owner(s).select("path", "commits")


@query
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.stale(B.signals(spark, sf_dir), days=30).select("rel", "code", "days_since")


@query
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.shapes(spark, sf_dir).join(history.file_history(B.changes(spark, sf_dir)).select(F.col("path").alias("rel"), "commits"), "rel", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    return rankings.orphans(s).select("rel", "code")


@query
def deleted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.deleted(history.file_history(B.changes(spark, sf_dir)), B.present(spark, sf_dir)).select("path", "commits")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.timeline(history.month_activity(B.plain_commits(spark, sf_dir)), B.today(spark, sf_dir))


@query
def timeline_26m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


@query
def cadence_6m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.cadence(_timeline(spark, sf_dir)).select("active_months", *r6("cadence"))


@query
def peak_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.peak(_timeline(spark, sf_dir))


@query
def timeline_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.downsample(_timeline(spark, sf_dir), "ord", "commits", 4)


@query
def author_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rankings.author_rank(_authors(spark, sf_dir), B.today(spark, sf_dir))
    return a.select("key", "non_merge", "tenure_days", "last_active", "label", *r6("share"))


@query
def topk_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.top(_authors(spark, sf_dir), 15, F.desc("commits"), F.col("first_seq")).select("key", "commits")


@query
def median_per_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.shapes(spark, sf_dir).select((F.col("complexity") / F.greatest(F.lit(1), F.col("funcs"))).alias("v"))
    return rankings.percentile(s, "v", 0.5).select(*r6("value"))


@query
def author_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.search_authors(_authors(spark, sf_dir), "R 12").select("key", "commits")


# ---- text

MARKERS = {"THE": 1, "CONTENT": 2, "LICENSE": 3, "COPYRIGHT": 2}
WORDS = ("the", "in", "of the")
PATTERNS = (r"\bthe\s+\w+", r"(?m)^[A-Z]\w+")


@query
def line_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.line_census(F.col("text"), "#").alias("c")).select("doc_id", "c.*")


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.marker_rows(B.table(spark, sf_dir, "documents"), "doc_id", "text", MARKERS)


@query
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.marker_counts(_markers(spark, sf_dir), "doc_id")


@query
def oldest_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _markers(spark, sf_dir).select(F.col("doc_id").cast("string").alias("rel"), "line", "marker", "weight", "text")
    return text.oldest_marker(m, B.signals(spark, sf_dir)).select("rel", "line", "marker", "days_since")


@query
def suppression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(r"(?i)licen[cs]e|copyright|spdx")).cast("long").alias("suppressed")).where("suppressed > 0")


@query
def keyword_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", text.keyword_decisions(F.col("text"), WORDS).alias("decisions"))


@query
def operator_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", text.operator_decisions(F.col("url")).alias("decisions"))


@query
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", text.nesting_depth(F.col("html")).alias("depth"))


@query
def definition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", text.definitions(F.col("text"), PATTERNS).alias("funcs"))


@query
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.comments(F.col("html"), "<!--", "-->")
    return B.table(spark, sf_dir, "pages").select("page_id", F.size(c).cast("long").alias("n"), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.size(F.split(x, "\n"))).alias("lines"))


HREF = 'href="([^"]*)"'


@query
def import_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.import_specs(B.table(spark, sf_dir, "pages"), "page_id", "html", HREF)


@query
def language_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.shapes(spark, sf_dir).withColumn("test", F.col("is_test"))
    out = text.language_rollup(files)
    return out.select(F.when(F.col("all") == 1, "*").otherwise(F.col("language")).alias("language"), *(c for c in out.columns if c not in ("language", "all")))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of part attributes, with sizes."""
    k, s = F.col("p_partkey"), F.col("p_size")
    names = F.array(*map(F.lit, ["src", "node_modules", "lib", "gen", "tests", "dist", "a.b"]))
    exts = F.array(*map(F.lit, [".ts", ".py", ".png", ".d.ts", ".min.js", "", ".Md", ".test.js", ".pb.go"]))
    rel = F.concat(F.element_at(names, (k % 7 + 1).cast("int")), F.lit("/p"), k.cast("string"), F.element_at(exts, (k % 9 + 1).cast("int")))
    return B.table(spark, sf_dir, "part").select(rel.alias("rel"), F.when(k % 17 == 0, None).otherwise(s % 50 * 40_000).cast("long").alias("size"))


@query
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.classify(_paths(spark, sf_dir), exclude=["/p1", ""])


@query
def skip_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.skip_histogram(text.classify(_paths(spark, sf_dir), exclude=["/p1"]))


@query
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("rel")
    return _paths(spark, sf_dir).select("rel", X.basename(p).alias("base"), X.extension(p).alias("ext"), X.parent(p).alias("parent"), X.top_dirs(p, 2).alias("top"))


# ---- coverage


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.shapes(spark, sf_dir).withColumn("test", F.col("is_test"))


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.tested(B.part_edges(spark, sf_dir), _files(spark, sf_dir))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tested(spark, sf_dir).withColumn("is_tested", F.lit(True))
    return _files(spark, sf_dir).join(t, "rel", "left").withColumn("is_tested", F.coalesce("is_tested", F.lit(False)))


@query
def tested_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(spark, sf_dir)


@query
def coverage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.totals(_covered(spark, sf_dir)).select("source_files", "covered", *r6("ratio"))


@query
def coverage_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = coverage.by_directory(_covered(spark, sf_dir), directory="dir")
    return d.select("dir", "source", "tests", "covered", "code", *r6("ratio", "code_per_test"))


@query
def least_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.least_covered(coverage.by_directory(_covered(spark, sf_dir), directory="language")).select("dir", "source", "tests", "covered")


# ---- graph


@query
def edges_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_edges(spark, sf_dir)


@query
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in(B.part_edges(spark, sf_dir))


@query
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_out(B.part_edges(spark, sf_dir))


@query
def blast_radius_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.top(graph.fan_in(B.part_edges(spark, sf_dir)), 10, F.desc("fan_in"), F.col("rel"))


@query
def reverse_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.importers_of(B.part_edges(spark, sf_dir), "7")


@query
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(B.event_edges(spark, sf_dir))


@query
def cycle_vs_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(graph.cycles(B.event_edges(spark, sf_dir))).select("component", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.col("size").cast("long").alias("size"), "kind")


@query
def cluster_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.event_edges(spark, sf_dir)
    return graph.cluster_core(graph.cycles(e), graph.fan_in(e))


@query
def owner_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.owner_label(B.signals(spark, sf_dir), _authors(spark, sf_dir)).select("rel", "owner")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = text.import_specs(B.table(spark, sf_dir, "pages"), "page_id", "html", HREF)
    known = specs.where(F.length("spec") <= 4).select(F.col("spec").alias("path")).distinct()
    s = F.col("spec")
    options = F.array(s, F.substring(s, 1, 4), F.substring(s, 1, 3), F.lower(F.substring(s, 1, 3)))
    return graph.first_match(specs.select(F.col("page_id").alias("src"), "spec"), ["src", "spec"], options, known)


@query
def resolve_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


def _externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of unresolved links, seen from the root."""
    return graph.externals(_resolved(spark, sf_dir).withColumn("spec", F.regexp_replace("spec", "^/+", "")))


@query
def externals_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.top(_externals(spark, sf_dir), 15, F.desc("importers"), F.col("name"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared names: the last parts of the hosts of pages, and every second external."""
    e = _externals(spark, sf_dir).where(F.length("name") % 2 == 0).select(F.upper("name").alias("name"))
    hosts = B.table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/.]*)", 1).alias("name"))
    return e.union(hosts).distinct()


@query
def undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undeclared(_externals(spark, sf_dir), _manifest(spark, sf_dir), ["npm"])


@query
def unused_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unused(_externals(spark, sf_dir), _manifest(spark, sf_dir), ["npm"])


@query
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.part_edges(spark, sf_dir)
    return e.select(F.col("src").alias("rel")).union(e.select("dst")).distinct()


@query
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.part_edges(spark, sf_dir)
    return e.select(F.col("src").alias("rel")).distinct().join(e.select(F.col("dst").alias("rel")), "rel", "left_anti")


# ---- scores


@query
def repo_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.maxima(B.signals(spark, sf_dir))
    return m.withColumn("max_per_function", F.round("max_per_function", 6))


@query
def risk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.parts(B.signals(spark, sf_dir)).select("rel", *r6(*scoring.PART_OF.values()))


@query
def risk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.hotspots(scoring.risk(B.signals(spark, sf_dir))).select("rel", "commits", "fan_in", *r6("risk"))


@query
def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.hotspots(scoring.risk(B.signals(spark, sf_dir)), 50)
    return s.select("rel", F.posexplode("reasons").alias("place", "r")).select("rel", "place", "r.key", F.round("r.contribution", 6).alias("contribution"))


@query
def untested_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.untested_hot(scoring.hotspots(scoring.risk(B.signals(spark, sf_dir)), 100)).select("rel", *r6("risk"))


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.signals(spark, sf_dir)
    authors = rankings.author_rank(_authors(spark, sf_dir), B.today(spark, sf_dir))
    one = s.agg(F.count("*").alias("files"), F.sum("debt").alias("debt"), F.sum("code").alias("code"), F.count_if("in_cycle").alias("cyclic_files"))
    rankable = s.where("rankable")
    sides = [
        rankings.percentile(rankable, "per_function", 0.5).select(F.col("value").alias("median_per_function")),
        coverage.totals(s.withColumn("test", F.col("is_test"))).select(F.col("ratio").alias("test_ratio")),
        authors.agg(F.count("*").alias("authors"), F.count_if(F.col("last_active") <= 180).alias("active_authors")),
        rankings.churn_concentration(rankable).select(F.col("share").alias("churn_share")),
        rankings.cadence(_timeline(spark, sf_dir)).select("active_months"),
    ]
    for side in sides:
        one = one.crossJoin(F.broadcast(side))  # one row each
    return scoring.health(one)


@query
def health_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("key", "value")


@query
def health_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.index(_health(spark, sf_dir))


@query
def fail_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fails(scoring.index(_health(spark, sf_dir)), "C")


# ---- incremental


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where("size is not null").withColumn("mtime_ns", F.col("size") * 1000 + 7)


@query
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("rel", cache.key("abc", F.col("rel"), F.col("size"), F.col("mtime_ns")).alias("cache_key"), cache.shard(F.col("rel")).alias("shard"))


@query
def cache_hit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).withColumn("cache_key", cache.key("abc", F.col("rel"), F.col("size"), F.col("mtime_ns")))
    return cache.hit_rate(cache.split(r, r.where("size % 3 = 0").select("cache_key"))).select("hits", "misses", *r6("hit_rate"))


@query
def rename_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history.file_history(B.changes(spark, sf_dir, fine=True)).select("path", "born_commit", "first_seq", "commits", "adds", "dels")
    h = scratch.written(h, "history")
    m = history.rename_matches(h, h.where("commits % 2 = 0").select("path"))
    return history.fold_history(h, m).where("inferred_from is not null").select("path", "inferred_from", "commits", "adds", "dels")


@query
def incremental_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File churn merged from three partial aggregates, as micro-batches deliver them."""
    ch = B.changes(spark, sf_dir)
    halves = [incremental.partial(ch.where(F.pmod(F.col("hash"), F.lit(3)) == k)) for k in range(3)]
    state = halves[0]
    for h in halves[1:]:
        state = incremental.merge(state, h)
    return incremental.result(state).select("path", "commits", "adds", "dels", "first_day", "last_day", "born_commit", "last_author")


@query
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File churn of the commits as files that arrive one after the other and are folded by a stream."""
    at = f"{scratch.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = B.raw_commits(spark, sf_dir)
    for k in range(3):
        raw.where(F.pmod(F.xxhash64("hash"), F.lit(3)) == k).write.mode("append").json(f"{at}/in")
        incremental.follow(spark, f"{at}/in", f"{at}/state", f"{at}/progress").awaitTermination()
    return incremental.result(incremental.read_state(spark, f"{at}/state")).select("path", "commits", "adds", "dels", "first_day", "last_day", "born_commit", "last_author")


def queries() -> dict[str, Query]:
    return _registered | samples.queries()


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {k: v for k, v in {**SQL, **oracle_samples.SQL}.items() if k in known}
