"""Small source trees, logs and manifests, and queries that run the text and import path over them.

The rows are written out here; what the queries have to return is written out in
`oracle_samples`, as values, from the meaning of the operators and not by running them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .functions import exprs as X
from .functions import lexer
from .operators import coverage, graph, history, rankings
from .operators import text as T
from .schema import COMMIT
from .sources import manifests, workspace
from .sources.gitlog import FIELD, RECORD, Parser

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def query(f: Query) -> Query:
    _registered[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_registered)


# ---- source texts

APP = """// TODO: split
import a from "./lib/a.js";
const b = require("../tools/b");
/* FIXME one
   two */
function run(x) {
  if (x && (x.y || [1])) { return x ? a : b; }
  return "if (x) // no";
}

"""
UTIL = """import os, sys as s
from .base import B

class A:
    def f(self, x):  # noqa
        if x and self.y or x:
            return [x for x in (1, 2)]

# TODO todo
"""
MAIN = 'package main\n\nimport "fmt"\n\nfunc main() {\n\tfor i := range x {\n\t\tgo f(i)\n\t}\n}\n'
FILES: list[tuple[str, bytes | None]] = [
    ("src/app.js", APP.encode()),
    ("src/lib/a.js", b"export const a = () => {\n  return 1;\n};\n"),
    ("src/app.test.js", b"import app from './app';\n"),
    ("tools/b.ts", b"// @ts-ignore\nexport class B { }\n/* eslint-disable */\n"),
    ("pkg/util.py", UTIL.encode()),
    ("cmd/main.go", MAIN.encode()),
    ("Main.java", b"import java.util.List;\nimport static a.B.c;\nclass Main { int f() { return 1; } }"),
    ("conf.yml", b"a: 1 # x\n# y\n\n"),
    ("lib.rs", b"use std::fmt;\nfn f() { while x { if y { } } }\n"),
    ("notes.xyz", b"one\n\ntwo"),
    ("data.js", b"x\0y"),
    ("gone.js", None),
    ("empty.css", b""),
]


def _shapes(spark: SparkSession) -> DataFrame:
    files = spark.createDataFrame(FILES, "rel string, content binary")
    return lexer.scan(files.withColumn("language", X.language_for(F.col("rel"))))


@query
def lexer_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark).select("rel", "language", "skip", "total", "code", "comment", "blank", "comments", "decisions", "depth", "funcs", "suppressed", "complexity", "bytes")


@query
def lexer_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark).select("rel", F.posexplode("debt").alias("place", "d")).select("rel", "place", "d.line", "d.marker", "d.weight")


@query
def lexer_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text whose comments begin with a number sign and which has no strings."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("rel"), F.col("text").alias("content"), F.lit("CMake").alias("language"))
    return lexer.scan(d.where("content is not null")).where("skip is null").select("rel", "total", "code", "comment", "blank", "comments")


@query
def unknown_language_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of an unknown language: its lines are counted and nothing else."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("rel"), F.col("html").alias("content"), F.lit(None).cast("string").alias("language"))
    return lexer.scan(d).where("skip = 'unknown-language'").select("rel", "total", "code")


IMPORTS = [
    ("JavaScript", "import x, { y } from './a'; import 'side'; const z = require(\"pkg/sub\"); import('./late'); require.resolve('r')"),
    ("TypeScript", "import type { T } from '@scope/t';\nexport * from \"../up\";\n"),
    ("Python", "from a.b import c\nfrom . import d\nimport os, sys as s\n  import late\n# import no\n"),
    ("Go", 'import "one"\nimport (\n\t"two"\n\t"x/three"\n)\n'),
    ("Rust", "use std::fmt;\nmod inner;\npub use crate::a;\n"),
    ("Java", "import java.util.List;\nimport static a.B.c;\n// import no.No;\n"),
    ("Kotlin", "import a.b.C\n"),
    ("C", "#include <stdio.h>\n#include \"own.h\"\n"),
    ("C++", "#  include <vector>\n"),
    ("C#", "using System.Text;\nusing static A.B;\n"),
    ("Ruby", "require 'json'\nrequire_relative('lib/x')\n"),
    ("PHP", "require_once 'a.php';\ninclude('b.php');\n"),
    ("Swift", "import Foundation\n"),
    ("Scala", "import a.b.{C, D}\n"),
    ("Shell", "source ./env.sh\n. lib/x\n"),
    ("Lua", "local a = require 'a.b'\nrequire(\"c\")\n"),
    ("Elixir", "import Ecto.Query\n"),
    ("Dart", "import 'package:a/b.dart';\n"),
    ("Vue", "import A from './A.vue'\n"),
    ("Svelte", "import B from \"./B.svelte\"\n"),
    ("Zig", 'const s = @import("std");\n'),
    ("Haskell", "import qualified Data.Map\nimport Prelude\n"),
    ("YAML", "import: a\n"),
]


@query
def lexer_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each import of one text a language."""
    rows = [(name, text.encode(), name) for name, text in IMPORTS]
    return lexer.scan(spark.createDataFrame(rows, "rel string, content binary, language string")).select(F.col("rel").alias("language"), F.posexplode("imports").alias("place", "spec"))


SUPPRESSED = [
    ("JavaScript", "/* eslint-disable-next-line */ // @ts-expect-error\nconst s = '@ts-ignore';\n// x.noqa\n"),
    ("Python", "x = 1  # type: ignore\ny = 2  # noqa\nz = 3  # pragma: no cover\n"),
    ("Go", "x() // nolint\n// nolinting\n"),
]


@query
def lexer_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, text.encode(), name) for name, text in SUPPRESSED]
    return lexer.scan(spark.createDataFrame(rows, "rel string, content binary, language string")).select(F.col("rel").alias("language"), "suppressed", "comments")


# ---- paths and imports

JOINS = [
    ("src/a/x.ts", "../b/./c.js"), ("x.js", "../../y.js"), ("a/b.js", "./"), ("a/b.js", "lodash/fp"), ("a/b.js", "@/c"), ("a/b.js", "~lib/d"), ("a/b.js", "node:fs"),
    ("a/b.js", "dart:io"), ("a/b.js", "package:http/http.dart"), ("a/b.js", "@org/kit/x"), ("a/b.js", "https://x.y/z"), ("a/b.js", "#in"), ("a/b.js", "odd word"), ("a/b.js", ""),
]


@query
def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("importer"), F.col("spec")
    d = spark.createDataFrame(JOINS, "importer string, spec string")
    return d.select("importer", "spec", X.join_path(i, s).alias("joined"), X.relative_import(i, s).alias("relative"), X.clean_spec(s).alias("clean"), X.external_name(s).alias("package"))


@query
def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("src/ui/a.ts", "./b"), ("a/b/c.py", "x.y"), ("m.py", "n"), ("a/b.js", "!odd")], "importer string, spec string")
    return d.select("importer", "spec", F.posexplode(graph.candidates(F.col("importer"), F.col("spec"), [".ts", ".py"], ["index.ts"])).alias("place", "path"))


def _tree_imports(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    shapes = _shapes(spark)
    return shapes.select(F.col("rel").alias("src"), F.explode("imports").alias("spec")), shapes.select(F.col("rel").alias("path"))


@query
def tree_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts, names = graph.probe_lists(spark.createDataFrame([("a/x.py",), ("b/index.ts",), ("c.ts",), ("index.js/no",), ("d.md",)], "path string"))
    return spark.createDataFrame([("ext", i, x) for i, x in enumerate(exts)] + [("index", i, x) for i, x in enumerate(names)], "kind string, place int, value string")


@query
def tree_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_imports(*_tree_imports(spark))


@query
def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(graph.resolve_imports(*_tree_imports(spark)))


STEMS = ["src/a.test.ts", "src/a.spec.jsx", "lib/tests/b.py", "pkg/test_c.py", "pkg/d_test.go", "e/test.js", "src/__tests__/f.js", "g.py"]


@query
def test_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return spark.createDataFrame([(s,) for s in STEMS], "path string").select("path", X.test_stem(p).alias("stem"), X.test_stem(p, keep_extension=True).alias("with_extension"))


@query
def tested_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that tests are named after, beside one that a test imports."""
    rows = [("src/a.ts", False), ("src/a.test.ts", True), ("lib/b.py", False), ("lib/tests/b.py", True), ("pkg/c.py", False), ("pkg/test_c.py", True), ("lone.py", False), ("far.py", False)]
    e = spark.createDataFrame([("pkg/test_c.py", "far.py"), ("lone.py", "src/a.ts")], "src string, dst string")
    files = spark.createDataFrame(rows, "rel string, test boolean")
    plain = coverage.tested(e, files).withColumn("rule", F.lit("plain"))
    return plain.unionByName(coverage.tested(e, files, keep_extension=True).withColumn("rule", F.lit("with extension")))


@query
def languages_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language filter over the parts' paths: what a scan would read."""
    from .queries import _paths

    return workspace.kept(T.classify(_paths(spark, sf_dir)), "typescript").select("rel", "size")


@query
def hot_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _paths

    return rankings.search_files(_paths(spark, sf_dir), "P12").select("rel")


# ---- scalars

DATES = ["1970-01-01", "1970-03-01", "2000-02-29", "2024-13-40", "", None, "1999"]


@query
def days_and_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return spark.createDataFrame([(x,) for x in DATES], "d string").select("d", X.day_index(d).alias("day"), X.month_of(d).alias("bucket"))


@query
def recency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("days")
    return spark.createDataFrame([(x,) for x in (0, 7, 8, 30, 31, 90, 91, 180, 181, 365, 366, 730, 731)], "days int").select("days", X.recency_bucket(d).alias("recency"), X.activity(d).alias("label"))


@query
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return spark.createDataFrame([(x,) for x in (-1.5, -0.4, 0.5, 1.49, 2.5, 84.99)], "v double").select("v", X.js_round(v).cast("long").alias("rounded"), X.clamp(v).alias("clamped"), X.grade(v).alias("grade"))


@query
def python_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("My_Pkg",), ("a-b",), ("A__b",)], "name string").select("name", X.normalize_py(F.col("name")).alias("normal"))


# ---- log, manifests, history

_H = [c * 40 for c in "abc"]


def _commit(h: str, parents: str, who: str, day: str, subject: str, body: str) -> str:
    return RECORD + FIELD.join([h, parents, who, who.lower() + "@x.org", day, subject]) + body


LOGS = {
    "names": _commit(_H[0], _H[1], "Ann", "2024-02-03", "one", "\n\0new.py\0src/a b.py\0\0") + _commit(_H[1], "", "Bob", "2024-02-01", f"odd{FIELD}subject", "\n\0x\0"),
    "lines": _commit(_H[0], f"{_H[1]} {_H[2]}", "Ann", "2024-02-03", "merge", "\n\0" + "3\t1\tx.py\0" + "-\t-\tpic.png\0" + "0\t2\t\0old.py\0new.py\0") + _commit(_H[2], "", "Cid", "2024-01-01", "empty", "\0"),
}


@query
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of the log stream in both modes, fed in chunks of seven characters; a row a change, or one without a path."""
    rows = []
    for mode, log in LOGS.items():
        parser = Parser(lines=mode == "lines")
        commits = [c for i in range(0, len(log), 7) for c in parser.feed(log[i : i + 7])] + list(parser.close())
        rows += [(mode, *c) for c in commits]
    schema = StructType([StructField("mode", StringType()), *COMMIT.fields])
    return spark.createDataFrame(rows, schema).select("mode", "seq", "hash", "author", "email", "date", "merge", "subject", F.inline_outer("files")).withColumnRenamed("del", "dele").fillna(False, ["binary", "rename"])


MANIFESTS = [
    ("package.json", '{"name": "x", "dependencies": {"react": "1", "@a/b": "^2"}, "devDependencies": {"jest": "3"}}'),
    ("requirements.txt", "# no\nFlask_Login==1\nnumpy>=2\nrequests\n"),
    ("go.mod", "module m\n\nrequire (\n\texample.com/x v1.2.3\n\tgithub.com/a/b v0.1.0 // indirect\n)\n"),
    ("Cargo.toml", "[package]\nname = \"c\"\n[dependencies]\nserde = \"1\"\nrand_core = { version = \"2\" }\n[dev-dependencies]\nno = \"1\"\n"),
    ("Gemfile", "gem 'rails', '~> 7'\ngem \"puma\"\n"),
    ("pyproject.toml", "[project]\ndependencies = [\n  \"Django>=4\",\n  'typing_ext',\n]\n"),
    ("sub/package.json", '{"dependencies": {"no": "1"}}'),
]


@query
def manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.parse(spark.createDataFrame(MANIFESTS, "rel string, content string"))


def _small_history(spark: SparkSession) -> DataFrame:
    """Commit 1 (the oldest) makes old/a.py, old/b.py and keep.py; commit 2 makes new/a.py, new/c.py and old/z.py; later ones change some."""
    days = {1: 100, 2: 200, 3: 300}
    rows = [
        (1, "ann", "old/a.py", 10, 0), (1, "ann", "new/a.py", 5, 0), (1, "ann", "new/a.pyx", 1, 0), (1, "ann", "old/b.py", 3, 1), (2, "bob", "old/a.py", 2, 2),
        (2, "bob", "new/c.py", 1, 0), (2, "bob", "old/z.py", 1, 0), (3, "ann", "new/a.py", 4, 1), (3, "bob", "keep.py", 1, 1),
    ]
    made = [(n, f"c{n}", who, days[n], f"1970-{n:02d}", path, add, dele) for n, who, path, add, dele in rows]
    d = spark.createDataFrame(made, "n int, hash string, key string, day int, bucket string, path string, add int, del int")
    return d.select("hash", "key", "day", "bucket", "path", "add", "del", F.lit(False).alias("binary"), F.lit(False).alias("rename"), F.lit(None).cast("string").alias("old_path"), (3 - F.col("n")).cast("long").alias("seq"), F.lit("s").alias("subject"))


def _small_matches(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    ch = _small_history(spark)
    h = history.file_history(ch)
    here = spark.createDataFrame([("new/a.py",), ("new/a.pyx",), ("new/c.py",), ("keep.py",)], "path string")
    return ch, h, history.rename_matches(h, here)


@query
def rename_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small_matches(spark)[2]


@query
def rename_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, h, m = _small_matches(spark)
    return history.fold_history(h, m).select("path", "commits", "adds", "dels", "inferred_from")


@query
def author_files_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files of each author after renames are folded in."""
    ch, _, m = _small_matches(spark)
    return history.distinct_files(history.fold(history.file_author(ch), m, "key"), "key")


@query
def month_files_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch, _, m = _small_matches(spark)
    return history.distinct_files(history.fold(history.file_month(ch), m, "bucket"), "bucket")
