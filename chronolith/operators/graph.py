"""The import graph: candidates, first-match resolution, degrees, components, reconciliation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clean_spec, extension, external_name, join_path
from ..registry import INDEX_NAMES, LOCAL_NAMES, PROBE_EXTS, STDLIB, STDLIB_OF_KIND

#: Edges that one task may take for the strongly connected components of a trimmed graph.
LOCAL_EDGES = 2_000_000


def _array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def probe_lists(files: DataFrame) -> tuple[list[str], list[str]]:
    """The extensions and index names that files (path) have, in order of preference; all extensions if none is there."""
    exts = {r[0] for r in files.select(extension(F.col("path")).alias("e")).where(F.col("e").isin(PROBE_EXTS)).distinct().collect()}
    names = {r[0] for r in files.select(F.substring_index("path", "/", -1).alias("n")).where(F.col("n").isin(INDEX_NAMES)).distinct().collect()}
    return [e for e in PROBE_EXTS if e in exts] or PROBE_EXTS, [n for n in INDEX_NAMES if n in names]


def candidates(importer: Column, spec: Column, exts: Sequence[str] = tuple(PROBE_EXTS), indexes: Sequence[str] = tuple(INDEX_NAMES)) -> Column:
    """Paths that an import may mean, best first: for each base the path itself, with an extension, as a directory's index.

    Relative imports have one base; others are sought from the importer's directory
    up to the root, eight levels at most, and last below src.
    """
    clean = clean_spec(spec)
    dotted = F.when(F.contains(clean, F.lit("/")), clean).otherwise(F.replace(clean, F.lit("."), F.lit("/")))
    dirs = F.slice(F.split(importer, "/"), F.lit(1), F.size(F.split(importer, "/")) - 1)
    levels = F.sequence(F.size(dirs), F.greatest(F.lit(0), F.size(dirs) - 7), F.lit(-1))
    bases = F.transform(levels, lambda i: F.array_join(F.slice(dirs, F.lit(1), i), "/"))
    bases = F.array_distinct(F.concat(bases, F.array(F.lit("src"))))
    far = F.transform(bases, lambda b: F.when(b == "", dotted).otherwise(F.concat(b, F.lit("/"), dotted)))
    roots = F.when(F.startswith(clean, F.lit(".")), F.array(join_path(importer, clean))).when(clean.rlike(r"^[A-Za-z_][\w./-]*$"), far).otherwise(F.array().cast("array<string>"))
    ends = _array(["", *exts, *("/" + n for n in indexes)])
    return F.flatten(F.transform(F.coalesce(roots, F.array().cast("array<string>")), lambda r: F.transform(ends, lambda e: F.concat(F.regexp_replace(r, "/+$", ""), e))))


def first_match(specs: DataFrame, keys: Sequence[str], options: Column, known: DataFrame) -> DataFrame:
    """keys and target: the first of the options (an array) that known (path) has; null where none is.

    One exploded equi-join and one minimum; no loop over bases.
    """
    tried = specs.select(*keys, F.posexplode_outer(options).alias("place", "path"))
    hit = known.select("path", F.lit(True).alias("there"))
    return tried.join(hit, "path", "left").groupBy(*keys).agg(F.min(F.when(F.col("there"), F.struct("place", "path")))["path"].alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, spec, target) of imports (src, spec) against files (path)."""
    exts, indexes = probe_lists(files)
    return first_match(imports.distinct(), ["src", "spec"], candidates(F.col("src"), F.col("spec"), exts, indexes), files)


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) without self-imports."""
    return resolved.where("target is not null and target <> src").select("src", F.col("target").alias("dst")).distinct()


def externals(resolved: DataFrame) -> DataFrame:
    """(name, importers): unresolved imports a package."""
    return resolved.where("target is null").select(external_name(F.col("spec")).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("importers"))


def fan_in(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy(F.col("dst").alias("rel")).agg(F.count("*").alias("fan_in"))


def fan_out(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy(F.col("src").alias("rel")).agg(F.count("*").alias("fan_out"))


def importers_of(edges_: DataFrame, path: str) -> DataFrame:
    return edges_.where(F.col("dst") == path).select("src")


def trim(edges_: DataFrame, rounds: int = 3) -> DataFrame:
    """Drops edges whose ends have no way in or no way out: they are in no cycle."""
    for _ in range(rounds):
        both = edges_.select(F.col("src").alias("n")).distinct().join(edges_.select(F.col("dst").alias("n")).distinct(), "n", "left_semi")
        edges_ = edges_.join(both.withColumnRenamed("n", "src"), "src", "left_semi").join(both.withColumnRenamed("n", "dst"), "dst", "left_semi")
    return edges_


def components_of(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Strongly connected component of each node 0..n-1, by two iterative depth-first passes."""
    n = int(max(src.max(initial=-1), dst.max(initial=-1))) + 1

    def lists(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(a, kind="stable")
        return np.searchsorted(a[by], np.arange(n + 1)), b[by]

    at, to = lists(src, dst)
    seen, post = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, at[root])]
        while stack:
            node, i = stack.pop()
            if i < at[node + 1]:
                stack.append((node, i + 1))
                if not seen[to[i]]:
                    seen[to[i]] = True
                    stack.append((to[i], at[to[i]]))
            else:
                post.append(node)
    at, to = lists(dst, src)
    label = np.full(n, -1)
    for root in reversed(post):
        if label[root] < 0:
            stack2 = [root]
            label[root] = root
            while stack2:
                node = stack2.pop()
                for x in to[at[node] : at[node + 1]]:
                    if label[x] < 0:
                        label[x] = root
                        stack2.append(x)
    return label


def cycles(edges_: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(component, node): strongly connected components of two and more nodes, named by their smallest node.

    A graph of at most local_edges edges is solved in one task, whose size that count
    bounds; a larger one is trimmed and solved by rounds of forward and backward reach.
    """
    e = edges_.where("src <> dst").select("src", "dst").distinct()
    return _local_cycles(e) if e.limit(local_edges + 1).count() <= local_edges else _distributed_cycles(trim(e))


def _local_cycles(edges_: DataFrame) -> DataFrame:
    kind = edges_.schema["src"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
        label = components_of(codes[: len(pdf)], codes[len(pdf) :])
        out = pd.DataFrame({"node": names, "l": label})
        out = out[out.groupby("l")["node"].transform("size") > 1]
        return pd.DataFrame({"component": out.groupby("l")["node"].transform("min"), "node": out["node"]})

    return edges_.groupBy(F.lit(1).alias("one")).applyInPandas(solve, f"component {kind}, node {kind}")


def _distributed_cycles(edges_: DataFrame) -> DataFrame:
    """Colours spread forwards (the smallest ancestor); what reaches its colour's root backwards within the colour is its component."""
    spark = edges_.sparkSession
    kind = edges_.schema["src"].dataType.simpleString()
    found = spark.createDataFrame([], f"component {kind}, node {kind}")
    e = edges_.checkpoint()
    while not e.isEmpty():
        colour = e.select(F.col("src").alias("n")).union(e.select("dst")).distinct().withColumn("c", F.col("n"))
        while True:
            pushed = e.join(colour.withColumnRenamed("n", "src"), "src").select(F.col("dst").alias("n"), F.col("c").alias("p")).groupBy("n").agg(F.min("p").alias("p"))
            new = colour.join(pushed, "n", "left").select("n", F.least("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") < F.col("c")).alias("moved")).checkpoint()
            colour = new.select("n", "c")
            if new.where("moved").isEmpty():
                break
        inner = e.join(colour.select(F.col("n").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("n").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")).checkpoint()
        reach = colour.where("n = c").checkpoint()
        while True:
            more = inner.join(reach.select(F.col("n").alias("dst")), "dst", "left_semi").select(F.col("src").alias("n"), "c").distinct().join(reach, ["n", "c"], "left_anti").checkpoint()
            if more.isEmpty():
                break
            reach = reach.union(more).checkpoint()
        found = found.union(reach.select(F.col("c").alias("component"), F.col("n").alias("node"))).checkpoint()
        done = reach.select("n")
        e = trim(inner.select("src", "dst").join(done.withColumnRenamed("n", "src"), "src", "left_anti").join(done.withColumnRenamed("n", "dst"), "dst", "left_anti"), 1).checkpoint()
    many = found.groupBy("component").count().where("count > 1")
    return found.join(many.select("component"), "component", "left_semi")


def components(members: DataFrame, cluster_over: int = 8) -> DataFrame:
    """A row a component: members in order, size, and whether it is a cluster or a small cycle."""
    return members.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members")).withColumn("size", F.size("members")).withColumn("kind", F.when(F.col("size") > cluster_over, "cluster").otherwise("cycle"))


def cluster_core(members: DataFrame, fan_in_: DataFrame, k: int = 4) -> DataFrame:
    """(component, node, fan_in, place): the k members of each component that most files import, equal ones by name."""
    w = Window.partitionBy("component").orderBy(F.desc("fan_in"), "node")
    ranked = members.join(fan_in_.select(F.col("rel").alias("node"), "fan_in"), "node").withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= k).select("component", "node", "fan_in", "place")


def undeclared(externals_: DataFrame, manifest: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Externals that no manifest (name) declares and that are neither standard nor local names."""
    free = sorted({x for k in kinds if k in STDLIB_OF_KIND for x in STDLIB[STDLIB_OF_KIND[k]]} | set(LOCAL_NAMES))
    lower = F.lower("name")
    return externals_.where(~lower.isin(free)).withColumn("l", lower).join(manifest.select(F.lower("name").alias("l")).distinct(), "l", "left_anti").drop("l")


def unused(externals_: DataFrame, declared: DataFrame, kinds: Iterable[str], k: int = 50) -> DataFrame:
    """The first k declared names (name) that nothing imports; standard, scoped and self names do not count."""
    free = sorted({x for kind in kinds if kind in STDLIB_OF_KIND for x in STDLIB[STDLIB_OF_KIND[kind]]} | {"self"})
    names = declared.select(F.lower("name").alias("name")).distinct().where(~F.col("name").isin(free) & ~F.startswith(F.col("name"), F.lit("@")))
    return names.join(externals_.select(F.lower("name").alias("name")).distinct(), "name", "left_anti").orderBy("name").limit(k)
