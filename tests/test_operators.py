"""Operators on small fixtures, with nulls, ties and empty input."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import exprs as X
from chronolith.functions import lexer
from chronolith.operators import graph, history, rankings, scoring, text
from chronolith.sources import manifests
from chronolith.sources.gitlog import FIELD, RECORD, Parser
from chronolith.streaming import incremental


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


# ---- lexer


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("JavaScript", "// a\n\nconst x = 1; // b\n/* c\n d */\n\nlet y;\n\n// e\n", {"total": 9, "code": 2, "comment": 4, "blank": 3}),
        ("JavaScript", 'const q = "is it? really?";', {"decisions": 0}),
        ("JavaScript", "// if for while\n/* case catch */\n", {"decisions": 0, "funcs": 0}),
        ("JavaScript", "function f(a) {\n if (a) { for (;;) {} }\n if (b) {}\n try {} catch (e) {}\n return a ? 1 : 2;\n}\n", {"decisions": 4, "funcs": 1}),
        ("JavaScript", "const t = `a ${b}\nc`;\n", {"code": 2}),
        ("Python", 'color = "#ff0000"  # c\nx = 1\n', {"code": 2, "comment": 0}),
        ("Python", "# a\n# b\nx = 1\n", {"code": 1, "comment": 2}),
        ("Python", "def f():\n   \n    return 1\n", {"total": 3, "code": 2, "blank": 1, "funcs": 1}),
        ("YAML", "if: true\n", {"decisions": 0, "complexity": 0}),
        ("JavaScript", "a && b || c ?? d; x?: y; {[({})]}", {"depth": 4, "complexity": 6}),
        ("JavaScript", r"const s = '\''; // z" + "\n", {"code": 1, "comments": 1}),
        ("JavaScript", "", {"total": 0, "code": 0, "blank": 0}),
    ],
)
def test_measures(language, source, want):
    got = lexer.measure(source, language)
    assert {k: got[k] for k in want} == want


def test_debt_suppressions_and_imports():
    m = lexer.measure("// TODO: rewrite\nx\n/* FIXME y */\n/* eslint-disable */\n// @ts-ignore\nconst s = 'TODO';\n", "JavaScript")
    assert [(d["marker"], d["line"], d["weight"]) for d in m["debt"]] == [("FIXME", 3, 3), ("TODO", 1, 2)]
    assert m["suppressed"] == 2
    assert lexer.measure('import a from "./a.js"; const b = require("./b"); import type { X } from "./x"; import("./d")', "JavaScript")["imports"] == ["./b", "./a.js", "./x", "./d"]
    assert lexer.measure("from services.user import U\nimport os, sys as s\n", "Python")["imports"] == ["services.user", "os", "sys"]
    assert lexer.measure("import java.util.List;\nimport static a.B.c;\n", "Java")["imports"] == ["java.util.List", "a.B.c"]


def test_scan_of_odd_files(spark):
    rows = [("a.js", b"x\n", "JavaScript"), ("b.bin", b"a\0b", "C"), ("c.zz", b"1\n2", None), ("d.js", None, "JavaScript"), ("e.js", "// naïve\n".encode() * 50_000, "JavaScript")]
    got = {r.rel: r for r in lexer.scan(spark.createDataFrame(rows, "rel string, content binary, language string")).collect()}
    assert got["a.js"].code == 1 and got["b.bin"].skip == "binary" and (got["c.zz"].skip, got["c.zz"].total) == ("unknown-language", 2)
    assert got["d.js"].skip == "missing" and got["e.js"].comment == 50_000


# ---- scalar functions


def test_paths(spark):
    rows = [("src/a/x.ts", "src/a/../b/./c.js"), ("x", ".bashrc"), ("a/b/c/d.tar.gz", ""), (None, None)]
    d = spark.createDataFrame(rows, "p string, q string")
    got = d.select(X.basename(F.col("p")), X.extension(F.col("p")), X.parent(F.col("p")), X.top_dirs(F.col("p"))).collect()
    assert [tuple(r) for r in got[:3]] == [("x.ts", ".ts", "src/a", "src/a"), ("x", "", "", "(root)"), ("d.tar.gz", ".gz", "a/b/c", "a/b")]
    j = spark.createDataFrame([("src/a/x.ts", "../b/./c.js"), ("x.js", "../../y.js"), ("a/b.js", "./")], "i string, s string")
    assert [r[0] for r in j.select(X.join_path(F.col("i"), F.col("s"))).collect()] == ["src/b/c.js", "y.js", "a"]
    assert [r[0] for r in j.select(X.relative_import(F.col("i"), F.col("s"))).collect()] == ["src/b/c.js", None, "a"]


def test_languages_and_classes(spark):
    want = {
        "a/Dockerfile": ("Docker", False, False), "x.d.ts": ("TypeScript", False, False), "lib/a.test.js": ("JavaScript", True, False), "tests/b.py": ("Python", True, False),
        "gen/x.go": ("Go", False, True), "a.min.js": ("JavaScript", False, True), "x.unknown": (None, False, False), "api/test_x.py": ("Python", True, False), "src/contest.py": ("Python", False, False),
    }
    d = spark.createDataFrame([(k,) for k in want], "p string")
    p = F.col("p")
    assert {r.p: (r.l, r.t, r.g) for r in d.select("p", X.language_for(p).alias("l"), X.is_test(p, X.language_for(p)).alias("t"), X.is_generated(p).alias("g")).collect()} == want


def test_names_and_dates(spark):
    specs = {"react": "react", "@scope/pkg/x": "@scope/pkg", "lodash/fp": "lodash", "package:flutter/a.dart": "flutter", "_odd word": None, "node:fs": "fs"}
    d = spark.createDataFrame([(k,) for k in specs], "s string")
    assert {r.s: r.n for r in d.select("s", X.external_name(F.col("s")).alias("n")).collect()} == specs
    a = spark.createDataFrame([("Ann", " A@X.org "), ("Root", ""), ("", None), (None, None)], "n string, e string")
    assert [r[0] for r in a.select(X.author_key(F.col("n"), F.col("e"))).collect()] == ["a@x.org", "name:root", "unknown", "unknown"]
    t = spark.createDataFrame([("2026-03-15",), ("nonsense",), ("x",), (None,)], "d string")
    assert [tuple(r) for r in t.select(X.day_index(F.col("d")), X.month_of(F.col("d"))).collect()] == [(20527, "2026-03"), (0, "nonsens"), (0, "unknown"), (0, "unknown")]
    stems = {"src/a.test.ts": "src/a", "pkg/tests/b.py": "pkg/b.py", "pkg/test_c.py": "pkg/c.py", "x/y_test.go": "x/y"}
    s = spark.createDataFrame([(k,) for k in stems], "p string")
    assert {r.p: r.x for r in s.select("p", X.test_stem(F.col("p")).alias("x")).collect()} == stems
    assert one(spark, X.test_stem(F.col("p"), keep_extension=True), p="src/a.test.ts") == "src/a.ts"


def test_scores_of_scalars(spark):
    d = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (5.0, 10.0), (20.0, 10.0), (-1.0, 3.0)], "v double, m double")
    assert [round(r[0], 4) for r in d.select(X.normalize(F.col("v"), F.col("m"))).collect()] == [0, 0, 0.7472, 1, 0]
    g = spark.createDataFrame([(85.0,), (84.9,), (60.0,), (42.0,), (1.0,)], "v double")
    assert [r[0] for r in g.select(X.grade(F.col("v"))).collect()] == ["A", "B", "C", "D", "E"]
    assert [r[0] for r in g.select(X.recency_bucket(F.col("v"))).collect()] == ["3 months"] * 3 + ["3 months", "this week"]


# ---- history


def _history(spark, rows):
    return history.prepare(spark.createDataFrame(rows, "seq long, hash string, author string, email string, date string, merge boolean, subject string, files array<struct<path:string,old_path:string,add:int,del:int,binary:boolean,rename:boolean>>"))


def test_history_fold(spark):
    f = lambda p, a=1, d=0, old=None, b=False: (p, old, None if b else a, None if b else d, b, old is not None)
    rows = [
        (0, "h0", "Ann", "a@x", "2024-02-01", True, "merge", []),
        (1, "h1", "Bob", "b@x", "2024-01-03", False, "s1", [f("new/x.py", 2, 1), f("y.py", b=True)]),
        (2, "h2", "Ann", "A@X", "2024-01-01", False, "s2", [f("old/x.py", 5), f("new/x.py", 1)]),
        (3, "h3", "Ann", "a@x", "junk", False, "s3", [f("y.py", 4)]),
    ]
    c, ch = _history(spark, rows)
    s = history.summary(c, ch).first()
    assert (s.commits, s.merges, s.empty_commits, s.authors, s.adds, s.dels, s.binary_changes) == (4, 1, 1, 2, 12, 1, 1)
    h = history.file_history(ch)
    x = {r.path: r for r in h.collect()}
    assert (x["new/x.py"].born_commit, x["new/x.py"].last_author, x["y.py"].first_day) == ("h2", "b@x", 19725)
    m = history.rename_matches(h, spark.createDataFrame([("new/x.py",), ("y.py",)], "path string"))
    assert [tuple(r) for r in m.collect()] == [("new/x.py", "old/x.py")]
    folded = {r.path: r for r in history.fold_history(h, m).collect()}
    assert (folded["new/x.py"].commits, folded["new/x.py"].adds, folded["new/x.py"].inferred_from) == (3, 8, "old/x.py")
    state = incremental.merge(incremental.partial(ch.where("seq < 2")), incremental.partial(ch.where("seq >= 2")))
    assert {r.path: (r.commits, r.born_commit) for r in incremental.result(state).collect()} == {p: (r.commits, r.born_commit) for p, r in x.items()}
    none = ch.limit(0)
    assert history.file_history(none).count() == 0 and history.summary(c.limit(0), none).first().commits == 0


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"seq": i, "hash": f"h{i}", "author": "A", "email": f"a{i % 3}@x", "date": f"2024-01-{1 + i % 28:02d}", "merge": False, "subject": "s", "files": [{"path": f"p{i % 4}", "old_path": None, "add": i, "del": 1, "binary": False, "rename": False}]} for i in range(40)]
    for k in range(2):
        (src / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k::2]))
        incremental.follow(spark, str(src), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = incremental.result(incremental.read_state(spark, str(tmp_path / "state"))).orderBy("path").collect()
    _, ch = _history(spark, [tuple(r[k] if k != "files" else [tuple(f.values()) for f in r[k]] for k in r) for r in rows])
    want = incremental.result(incremental.partial(ch)).orderBy("path").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_parser_in_any_chunks():
    rec = lambda h, p, s, files: f"{RECORD}{h * 40}{FIELD}{p}{FIELD}An{FIELD}a@x{FIELD}2024-01-01{FIELD}{s}\0{files}"
    log = rec("a", "p q", "two\x01parents", "") + rec("b", "p", "plain", "\n1\t2\ta b.txt\0-\t-\timg\x00" + "3\t0\t\0old\0new\0")
    for size in (1, 7, 10_000):
        p = Parser(lines=True)
        out = [r for i in range(0, len(log), size) for r in p.feed(log[i : i + size])] + [*p.close()]
        assert [(r[1][0], r[5], r[6]) for r in out] == [("a", True, "two parents"), ("b", False, "plain")]
        assert out[1][7] == [("a b.txt", None, 1, 2, False, False), ("img", None, None, None, True, False), ("new", "old", 3, 0, False, True)]


# ---- graph


def _brute_components(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n] |= reach[b]
    return {(min(c), n) for n in nodes if len(c := {m for m in nodes if m in reach[n] and n in reach[m]}) > 1}


@pytest.mark.parametrize("limit", [1000, 0])
def test_cycles(spark, limit):
    r = random.Random(4)
    edges = {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "c"), ("x", "x")} | {(f"n{r.randint(0, 14)}", f"n{r.randint(0, 14)}") for _ in range(18)}
    got = graph.cycles(spark.createDataFrame(sorted(edges), "src string, dst string"), limit)
    assert {(x.component, x.node) for x in got.collect()} == _brute_components(edges)
    assert graph.cycles(spark.createDataFrame([], "src string, dst string"), limit).count() == 0


def test_components_of_a_long_chain():
    n = 20_000
    assert len(np.unique(graph.components_of(np.arange(n), (np.arange(n) + 1) % n))) == 1


def test_resolution(spark):
    files = spark.createDataFrame([("src/b.js",), ("src/nested/deep.js",), ("api/svc/user.py",), ("src/lib/index.js",), ("top.py",)], "path string")
    want = {
        ("src/a.js", "./b"): "src/b.js", ("src/a.js", "./nested/deep.js"): "src/nested/deep.js", ("api/tests/t.py", "svc.user"): "api/svc/user.py", ("src/a.js", "./lib/"): "src/lib/index.js",
        ("src/a.js", "react"): None, ("x/y/z.py", "top"): "top.py", ("q/a.js", "lib"): "src/lib/index.js", ("src/a.js", "@/b"): "src/b.js", ("a.dart", "dart:io"): None, ("src/a.js", ""): None,
    }
    got = graph.resolve_imports(spark.createDataFrame(list(want), "src string, spec string"), files)
    assert {(r.src, r.spec): r.target for r in got.collect()} == want


def test_manifests(spark):
    rows = [
        ("package.json", b'{"dependencies": {"react": "1", "b-c": "2"}, "devDependencies": {"jest": "3"}}'), ("requirements.txt", b"Req_uests==2\n# no\nflask\n-e .\n"),
        ("go.mod", b"module x\nrequire (\n\tgithub.com/a/b v1.2\n)\n"), ("Cargo.toml", b'[package]\nname = "x"\n[dependencies]\nserde = "1"\n[dev]\nz = "2"\n'), ("Gemfile", b"gem 'rails'\n"),
        ("composer.json", b'{"require": {"a/b": "^1.0"}}'), ("pyproject.toml", b'dependencies = [\n "numpy>=1",\n]\n'), ("pom.xml", b"<x/>"), ("sub/package.json", b"{}"),
    ]
    got = {(r.kind, r.name, r.is_dev) for r in manifests.parse(spark.createDataFrame(rows, "rel string, content binary")).collect()}
    assert got == {
        ("npm", "react", False), ("npm", "b-c", False), ("npm", "jest", True), ("pip", "req-uests", False), ("pip", "flask", False), ("go", "github.com/a/b", False), ("cargo", "serde", False),
        ("bundler", "rails", False), ("composer", "a/b", False), ("pypi", "numpy", False), ("maven", None, None),
    }
    assert manifests.parse(spark.createDataFrame([("package.json", b"{oops")], "rel string, content binary")).count() == 0


# ---- rankings and scores


def test_bus_factor_and_ties(spark):
    d = lambda *n: spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(n)], "key string, commits long")
    for counts, want in (((10, 1, 1), 1), ((1, 1, 1, 1), 2), ((3, 3, 3), 2), ((5, 2, 2, 2, 1), 2), ((4, 2, 2, 2), 2), ((), 0)):
        assert rankings.bus_factor(d(*counts)).first()[0] == want, counts


def test_percentile_takes_an_element(spark):
    for values in ([1, 2, 3, 4], [7], [1, 1, 5], []):
        got = rankings.percentile(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 0.5).first()[0]
        assert got == (sorted(values)[(len(values) - 1) // 2] if values else None)


def test_text_expressions(spark):
    assert one(spark, text.operator_decisions(F.col("t")), t="a ?? b && c || d ? e : f?: x") == 5
    assert one(spark, text.nesting_depth(F.col("t")), t=")f(a){[x]}") == 2
    c = one(spark, text.line_census(F.col("t"), "#"), t="# a\n\nx\n")
    assert (c.total, c.code, c.comment, c.blank) == (3, 1, 1, 1)


def test_health_of_nothing(spark):
    facts = spark.createDataFrame([(0.0, 0.0, 0, 0, 0, 0, 0, 0, 0.0, 0)], "median_per_function double, test_ratio double, authors long, active_authors long, debt long, code long, cyclic_files long, files long, churn_share double, active_months long")
    h = scoring.health(facts)
    assert {r["key"]: r.value for r in h.collect()} == {"maintainability": 100, "tests": 0, "ownership": 100, "debt": 100, "structure": 100, "focus": 100, "velocity": 0}
    assert tuple(scoring.index(h).first()) == (71, "C")


@pytest.mark.parametrize("direct", [0, 10_000])
def test_rename_matches_of_large_commits(spark, monkeypatch, direct):
    monkeypatch.setattr(history, "DIRECT", direct)
    r = random.Random(3)
    names = ["a.py", "a.pyi", "ab.py", "b.js", "a", "index.js"]
    paths = sorted({f"{r.choice('xyz')}{r.randint(0, 9)}/{r.choice(names)}" for _ in range(90)})
    rows = [(p, f"c{r.randint(0, 2)}", i) for i, p in enumerate(paths)]
    kept = {p for p in paths if p[0] == "x"}
    got = {x.path: x.inferred_from for x in history.rename_matches(spark.createDataFrame(rows, "path string, born_commit string, first_seq long"), spark.createDataFrame([(p,) for p in kept], "path string")).collect()}

    def score(a, b):
        x, y = a.split("/")[-1], b.split("/")[-1]
        ext = lambda s: s[s.rindex(".") :] if "." in s[1:] else ""
        return (100 if x == y else 20 if x.startswith(y) or y.startswith(x) else 0) + 10 * (ext(x) == ext(y)) + 5 * (a.split("/")[0] == b.split("/")[0])

    want, used = {}, set()
    for new, commit, _ in rows:
        if new in kept:
            options = [(-score(old, new), seq, old) for old, c, seq in rows if old not in kept and c == commit and old not in used and score(old, new) >= 20]
            if options:
                want[new] = min(options)[2]
                used.add(want[new])
    assert got == want and len(want) > 5
