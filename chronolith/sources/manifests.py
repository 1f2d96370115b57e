"""Dependency manifests at the root of a tree, parsed with built-in expressions to (file, kind, name, is_dev)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalize_py
from ..registry import MANIFESTS


def _block(text: Column, pattern: str) -> Column:
    """The lines of group 1 of the first match."""
    return F.split(F.regexp_extract(text, pattern, 1), "\n")


def _first(lines: Column, pattern: str) -> Column:
    found = F.transform(lines, lambda s: F.regexp_extract(s, pattern, 1))
    return F.filter(found, lambda s: s != "")


def _json_keys(text: Column, path: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(text, path)), F.array().cast("array<string>"))


def parse(files: DataFrame, rel: str = "rel", content: str = "content") -> DataFrame:
    """Names that root manifests among files (rel, content) declare; a broken JSON manifest declares none and is dropped."""
    t = F.col(content).cast("string")
    kinds = F.create_map(*(F.lit(x) for kv in MANIFESTS.items() for x in kv))
    f = files.where(F.col(rel).isin(list(MANIFESTS))).select(F.col(rel).alias("file"), F.element_at(kinds, F.col(rel)).alias("kind"), t.alias("t"))
    f = f.where((F.col("kind") != "npm") | F.try_parse_json("t").isNotNull())
    t = F.col("t")
    own = F.filter(F.split(t, "\n"), lambda s: ~s.rlike(r"^\s*#"))
    # fixed values: what declares a dependency in each ecosystem
    names = {
        ("npm",): _json_keys(t, "$.dependencies"),
        ("pip", "pipenv"): F.transform(_first(own, r"^\s*([A-Za-z0-9_.-]+)\s*(?:[=<>!~\[]|$)"), normalize_py),
        ("go",): _first(_block(t, r"require\s*\(([^)]*)\)"), r"^\s*(\S+)\s+v"),
        ("cargo",): _first(_block(t, r"(?s)\[dependencies\](.*?)(?:\n\[|\z)"), r"^\s*([A-Za-z0-9_-]+)\s*="),
        ("bundler",): F.regexp_extract_all(t, F.lit(r"""gem\s+['"]([^'"]+)['"]"""), 1),
        ("composer",): F.regexp_extract_all(t, F.lit(r""""([^"]+)"\s*:\s*["'][~^*]"""), 1),
        ("pypi",): F.transform(_first(_block(t, r"(?s)dependencies\s*=\s*\[(.*?)\]"), r"""["']([A-Za-z0-9_.-]+)"""), normalize_py),
    }
    found = F.array().cast("array<string>")
    for kind, value in names.items():
        found = F.when(F.col("kind").isin(*kind), value).otherwise(found)
    dev = F.when(F.col("kind") == "npm", _json_keys(t, "$.devDependencies")).otherwise(F.array().cast("array<string>"))
    both = F.concat(F.transform(found, lambda n: F.struct(n.alias("name"), F.lit(False).alias("is_dev"))), F.transform(dev, lambda n: F.struct(n.alias("name"), F.lit(True).alias("is_dev"))))
    return f.select("file", "kind", F.explode_outer(both).alias("x")).select("file", "kind", "x.name", "x.is_dev")
