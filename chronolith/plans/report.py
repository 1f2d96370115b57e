"""The whole analysis of a repository as named DataFrames, its JSON projection and its text report."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexer
from ..operators import coverage, graph, history, rankings, scoring, text
from ..sources import cache, gitlog, manifests, scratch, workspace

SECTIONS = ("header", "health", "activity", "glance", "hotspots", "ownership", "structure", "debt", "tests", "footer")
SCHEMA, VERSION = 1, "0.1.0"


@dataclass
class Options:
    """What to analyse; see the command line for their meaning."""

    since: str | None = None
    until: str | None = None
    all: bool = True
    lines: bool = False
    max_commits: int | None = None
    top: int = 20
    lang: str | None = None
    path: str | None = None
    include_untracked: bool = False
    include_vendor: bool = False
    exclude: Sequence[str] = ()
    cache_dir: str | None = None
    today: str | None = None
    extras: dict[str, Any] = field(default_factory=dict)


@dataclass
class Report:
    """Sections by name; each is a lazy DataFrame."""

    meta: dict[str, Any]
    frames: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]


def measure(spark: SparkSession, records: DataFrame, root: str, cache_dir: str | None, today: str) -> DataFrame:
    """Shapes of the records; with a cache only files with new keys are read and lexed, and these are stored."""
    mark = cache.fingerprint()
    keyed = records.withColumn("cache_key", cache.key(mark, F.col("rel"), F.col("size"), F.col("mtime_ns")))
    old = cache.load(spark, cache_dir) if cache_dir else None
    if old is None:
        todo, known = keyed, None
    else:
        known = keyed.select("cache_key").join(old.dropDuplicates(["cache_key"]).drop("shard", "day"), "cache_key")
        todo = keyed.join(old.select("cache_key"), "cache_key", "left_anti")
    fresh = lexer.scan(workspace.contents(todo.select("rel", "language"), root)).join(keyed.select("rel", "cache_key"), "rel")
    if cache_dir:
        fresh = scratch.written(fresh, "fresh")
        cache.store(fresh, cache_dir, today)
    return (fresh if known is None else fresh.unionByName(known)).drop("cache_key")


def analyse(spark: SparkSession, root: str, options: Options | None = None) -> Report:
    """Collects, scans, folds history, resolves imports and scores; independent branches meet in signals.

    What several branches begin with is written once and read again, so that no plan holds another's.
    """
    o = options or Options()
    day = o.today or datetime.date.today().isoformat()
    today = F.to_date(F.lit(day))
    listed = workspace.files(spark, root, o.include_untracked, o.exclude, o.path)
    if o.include_vendor:
        listed = listed.withColumn("skip", F.when(F.col("skip") != "vendor", F.col("skip")))
    listed = scratch.written(listed, "listed")
    records = workspace.kept(listed, o.lang)
    shapes = scratch.written(measure(spark, records, root, o.cache_dir, day), "shapes")
    files = scratch.written(shapes.where("skip is null").join(records.select("rel", "test", "generated"), "rel"), "files")

    raw = scratch.written(gitlog.read_log(spark, root, mode="lines" if o.lines else "names", all=o.all, since=o.since, until=o.until, max_count=o.max_commits, pathspec=o.path), "raw")
    commits, changes = history.prepare(raw)
    per_file = scratch.written(history.file_history(changes), "per_file")
    present = records.select(F.col("rel").alias("path"))
    matches = scratch.written(history.rename_matches(per_file, present), "matches")
    pairs, months = history.fold(history.file_author(changes), matches, "key"), history.fold(history.file_month(changes), matches, "bucket")
    folded = history.fold_history(per_file, matches)
    authors = history.author_activity(commits).join(history.line_churn(changes, "key"), "key", "left").join(history.distinct_files(pairs, "key"), "key", "left").fillna(0, ["adds", "dels", "files"])
    authors = rankings.author_rank(authors, today)
    by_month = history.month_activity(commits).join(history.line_churn(changes, "bucket"), "bucket", "left").join(history.distinct_files(months, "bucket"), "bucket", "left").fillna(0, ["adds", "dels", "files"])
    line = rankings.timeline(by_month, today)

    imports = files.select(F.col("rel").alias("src"), F.explode("imports").alias("spec"))
    resolved = scratch.written(graph.resolve_imports(imports, present), "resolved")
    edges = scratch.written(graph.edges(resolved), "edges")
    cycles = scratch.written(graph.cycles(edges), "cycles")
    externals = graph.externals(resolved)
    declared = scratch.written(manifests.parse(workspace.contents(listed.where(F.col("rel").isin(list(manifests.MANIFESTS))).select("rel"), root)), "declared")
    kinds = [r[0] for r in declared.select("kind").distinct().collect()]  # at most one for each known kind
    n_manifests = declared.select("file").distinct().count()
    named = declared.where("name is not null")
    none = externals.limit(0)
    undeclared = graph.undeclared(externals, named, kinds) if n_manifests else none
    unused = graph.unused(externals, named.where("not is_dev"), kinds) if n_manifests == 1 else none.select("name")

    tested = scratch.written(coverage.tested(edges, files.select("rel", "test")), "tested")
    facts = files.select(
        "rel", "language", F.col("test").alias("is_test"), F.col("generated").alias("is_generated"), "code", "comment", "blank", "total", "decisions", "bytes", "depth", "complexity", "funcs", "suppressed",
        F.size("debt").alias("debt"), F.aggregate("debt", F.lit(0), lambda a, d: a + d["weight"]).alias("debt_weight"),
    )
    signals = scoring.signals(facts, folded, history.ownership(pairs), graph.fan_in(edges), graph.fan_out(edges), tested, cycles.select(F.col("node").alias("rel")), today)
    scored = scratch.written(scoring.risk(signals), "scored")
    covered = scored.select("rel", F.col("is_test").alias("test"), "is_tested", "code")
    hot = scoring.owner_label(scoring.hotspots(scored, o.top), authors).orderBy(F.desc("risk"), "rel")
    rankable = scored.where("rankable")
    markers = files.select("rel", F.inline("debt"))
    one = scored.agg(F.count("*").alias("files"), F.coalesce(F.sum("debt"), F.lit(0)).alias("debt"), F.coalesce(F.sum("code"), F.lit(0)).alias("code"), F.count_if("in_cycle").alias("cyclic_files"))
    sides = [
        rankings.percentile(rankable, "per_function", 0.5).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("median_per_function")),
        coverage.totals(covered).select(F.col("ratio").alias("test_ratio")),
        authors.agg(F.count("*").alias("authors"), F.count_if(F.col("last_active") <= 180).alias("active_authors")),
        rankings.churn_concentration(rankable).select(F.col("share").alias("churn_share")),
        rankings.cadence(line).select("active_months"),
    ]
    health = scoring.health(reduce(lambda a, b: a.crossJoin(F.broadcast(b)), sides, one))  # one row each
    summary = history.summary(commits, changes).crossJoin(F.broadcast(matches.agg(F.count("*").alias("folded")))).withColumn("renames", F.col("renames") + F.col("folded")).drop("folded")
    reason = next((r for r in ("since", "until", "max_commits", "path") if getattr(o, r)), None) or (None if o.all else "head only")
    roll = scratch.written(text.language_rollup(facts.withColumn("test", F.col("is_test"))), "roll")
    frames = {
        "history": summary.withColumns({"partial": F.lit(reason is not None), "partial_reason": F.lit(reason).cast("string")}),
        "skips": text.skip_histogram(listed),
        "totals": roll.where("all = 1").drop("language", "all", "first_rel"),
        "languages": roll.where("all = 0").orderBy(F.desc("code"), "first_rel").drop("all", "first_rel"),
        "authors": authors.orderBy(F.desc("commits"), "first_seq").drop("first_seq"),
        "bus_factor": rankings.bus_factor(authors),
        "single_owner": rankings.single_owner(scored).orderBy(F.desc("risk"), "rel"),
        "orphans": rankings.orphans(scored),
        "stale": rankings.stale(scored),
        "deleted": history.deleted(per_file, present).orderBy(F.desc("commits"), "first_seq").select("path", "commits"),
        "timeline": line.orderBy("ord"),
        "edges": edges,
        "cycles": graph.components(cycles).orderBy("size", "component"),
        "cluster_core": graph.cluster_core(cycles, graph.fan_in(edges)).orderBy("component", "place"),
        "externals": externals.orderBy(F.desc("importers"), "name").limit(15),
        "undeclared": undeclared.orderBy(F.desc("importers"), "name") if n_manifests else undeclared,
        "unused": unused,
        "tests": coverage.totals(covered),
        "directories": coverage.by_directory(covered).orderBy("ratio", F.desc("code"), "first_rel").drop("first_rel"),
        "untested_hot": rankings.untested_hot(hot),
        "debt": text.marker_counts(markers, "rel").orderBy(F.desc("weight"), F.desc("count"), "marker"),
        "oldest_debt": text.oldest_marker(markers, scored),
        "signals": scored,
        "hotspots": hot,
        "health": health.orderBy("ord").select("key", "value"),
        "index": scoring.index(health),
    }
    where = gitlog.head(root)
    return Report({"schema": SCHEMA, "version": VERSION, "repo": Path(root).name, "branch": where.get("branch"), "head": where.get("hash"), "today": day}, frames)


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def to_json(report: Report) -> dict[str, Any]:
    """The report without its signals; risks are rounded, rates have two decimals and points one.  Its sections are bounded by limits or by the number of authors, languages and cycles."""
    f = report.frames
    one = {k: (_rows(f[k]) or [{}])[0] for k in ("history", "totals", "tests", "index", "bus_factor")}
    timeline = _rows(f["timeline"])
    hot = f["hotspots"].select(
        F.col("rel").alias("path"), F.floor(F.col("risk") + 0.5).alias("risk"), "commits", "complexity", F.round("per_function", 2).alias("perFunction"), "depth", F.greatest(F.lit(1), "funcs").alias("functions"),
        "code", "debt", "authors", "owner", F.col("fan_in").alias("fanIn"), F.col("fan_out").alias("fanOut"), F.col("is_tested").alias("tested"), F.col("in_cycle").alias("inCycle"),
        F.transform("reasons", lambda r: F.struct(r["key"].alias("key"), F.round(r["contribution"], 1).alias("points"))).alias("reasons"),
    )
    cycles = [r["members"] for r in _rows(f["cycles"])]
    core: dict[str, list[dict[str, Any]]] = {}
    for r in _rows(f["cluster_core"]):  # at most four rows a cycle
        core.setdefault(r["component"], []).append({"path": r["node"], "fanIn": r["fan_in"]})
    debt = _rows(f["debt"])
    return {
        "meta": report.meta,
        "health": {**one["index"], "components": _rows(f["health"])},
        "totals": one["totals"],
        "languages": _rows(f["languages"]),
        "history": one["history"],
        "tests": {**one["tests"], "byDirectory": _rows(f["directories"])},
        "debt": {"byType": debt, "total": sum(d["count"] for d in debt), "oldest": next(iter(_rows(f["oldest_debt"])), None), "suppressed": one["totals"].get("suppressed", 0)},
        "ownership": {"busFactor": one["bus_factor"].get("bus_factor", 0), "total": f["authors"].count(), "authors": _rows(f["authors"]), "singleOwnerCount": f["single_owner"].count()},
        "structure": {"cycles": cycles, "cycleFileCount": sum(map(len, cycles)), "core": core, "undeclared": _rows(f["undeclared"]), "unused": [r["name"] for r in _rows(f["unused"])], "externals": _rows(f["externals"])},
        "timeline": {"months": timeline, "max": max((m["commits"] for m in timeline), default=0)},
        "hotspots": _rows(hot),
    }


def render(doc: dict[str, Any], sections: Sequence[str] = SECTIONS, limit: int = 20) -> str:
    """A plain text report of the JSON document, section by section."""
    h, t, s = doc["history"], doc["tests"], doc["structure"]
    bars = "▁▂▃▄▅▆▇█"
    top = max(1, doc["timeline"]["max"])
    parts = {
        "header": [f"{doc['meta']['repo']}  {doc['meta']['branch'] or ''}  {h.get('commits', 0)} commits  {h.get('authors', 0)} authors"],
        "health": [f"Health {doc['health'].get('value', 0)} ({doc['health'].get('grade', 'E')})", *(f"  {c['key']:<16}{c['value']:>4}" for c in doc["health"]["components"])],
        "activity": ["Activity  " + "".join(bars[min(7, m["commits"] * 7 // top)] for m in doc["timeline"]["months"])],
        "glance": ["Languages", *(f"  {x['language'] or 'Other':<14}{x['files']:>6} files {x['code']:>8} lines" for x in doc["languages"])],
        "hotspots": ["Hot files", *(f"  {x['risk']:>3}  {x['path']}  {x['owner']}  " + ", ".join(f"{r['key']} {r['points']}" for r in x["reasons"]) for x in doc["hotspots"][:limit])],
        "ownership": [f"Bus factor {doc['ownership']['busFactor']}, {doc['ownership']['singleOwnerCount']} files of one owner", *(f"  {a['name']:<24}{a['commits']:>6}  {a['label']}" for a in doc["ownership"]["authors"][:15])],
        "structure": [
            f"{len(s['cycles'])} cycles over {s['cycleFileCount']} files",
            *("  " + " -> ".join(c) for c in [c for c in s["cycles"] if len(c) <= 8][:4]),
            *(f"  cluster of {len(c)}, most imported: {', '.join(x['path'] for x in s['core'].get(min(c), []))}" for c in [c for c in s["cycles"] if len(c) > 8][:2]),
            *(f"  undeclared {x['name']} ({x['importers']})" for x in s["undeclared"][:8]),
            *(f"  unused {n}" for n in s["unused"][:8]),
        ],
        "debt": [f"{doc['debt']['total']} markers", *(f"  {d['marker']:<12}{d['count']:>5} in {d['files']} files" for d in doc["debt"]["byType"][:10])],
        "tests": [f"{t.get('covered', 0)} of {t.get('source_files', 0)} source files reached by a test", *(f"  {d['dir']}  {d['covered']}/{d['source']}" for d in t["byDirectory"][:10])],
        "footer": [f"schema {doc['meta']['schema']}, as of {doc['meta']['today']}"],
    }
    return "\n\n".join("\n".join(parts[s]) for s in SECTIONS if s in sections) + "\n"


def dumps(doc: dict[str, Any]) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False, default=str)
