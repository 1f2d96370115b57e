"""The git-native path end to end, on a repository of known shape that the test makes."""

from __future__ import annotations

import json
import os
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronolith.plans import cli, report
from chronolith.registry import RISK_WEIGHTS
from chronolith.sources import gitlog, workspace

FILES = {
    "src/a.js": 'import { b } from "./b.js";\nimport { c } from "./c.js";\nexport const a = 1;\n',
    "src/b.js": 'import { d } from "./d.js";\nexport const b = 1;\n',
    "src/c.js": 'import { d } from "./d.js";\nexport const c = 1;\n',
    "src/d.js": "export const d = 1;\n",
    "src/e.js": 'import { f } from "./f.js";\nexport const e = 1;\n',
    "src/f.js": 'import { e } from "./e.js";\nexport const f = 1;\n',
    "src/hot.js": "// TODO: tidy\n// FIXME: broken\n/* eslint-disable */\nexport function hot(x) {\n  if (x && x.y || x.z) { for (const k of x) { if (k) { return k ? 1 : 2; } } }\n  return 0;\n}\n",
    "test/d.test.js": 'import { d } from "../src/d.js";\n',
    "api/svc/user.py": "def get():\n    return 1\n",
    "api/tests/test_user.py": "from svc.user import get\nimport requests\nimport yaml\n",
    "requirements.txt": "requests==2.0.0\nflask\n# gone==1\n",
    "src/legacy.js": "export const legacy = 1;\n",
}


def run(cwd: Path, *args: str, day: str = "2024-03-01", who: str = "Ann") -> None:
    env = os.environ | {"GIT_AUTHOR_NAME": who, "GIT_AUTHOR_EMAIL": f"{who}@x.org", "GIT_COMMITTER_NAME": who, "GIT_COMMITTER_EMAIL": f"{who}@x.org", "GIT_AUTHOR_DATE": f"{day}T12:00:00Z", "GIT_COMMITTER_DATE": f"{day}T12:00:00Z"}
    subprocess.run(["git", "-c", "commit.gpgsign=false", *args], cwd=cwd, env=env, check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory: pytest.TempPathFactory) -> Path:
    at = tmp_path_factory.mktemp("repo")
    run(at, "init", "-q", "-b", "main")
    for name, text in FILES.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    run(at, "add", ".")
    run(at, "commit", "-qm", "first")
    for i in range(5):
        (at / "src/hot.js").write_text(FILES["src/hot.js"] + f"// {i}\n")
        run(at, "commit", "-qam", f"edit {i}", day=f"2024-0{4 + i}-10")
    return at


@pytest.fixture(scope="module")
def hostile(tmp_path_factory: pytest.TempPathFactory) -> Path:
    at = tmp_path_factory.mktemp("hostile")
    run(at, "init", "-q", "-b", "main")

    def put(name: str, data: bytes, subject: str, day: str) -> None:
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(data)
        run(at, "add", "-A")
        run(at, "commit", "-qm", subject, day=day)

    put("a.txt", b"1\n2\n3\n", "plain", "2024-01-01")
    put("dir with space/naïve é.txt", b"x\n", "odd path", "2024-01-02")
    run(at, "commit", "-qm", "empty", "--allow-empty", day="2024-01-03")
    run(at, "mv", "a.txt", "renamed.txt")
    (at / "renamed.txt").write_bytes(b"1\n2\n3\n4\n5\n6\n")
    run(at, "commit", "-qam", "move", day="2024-01-04")
    put("img.bin", bytes(range(256)), "binary", "2024-01-05")
    run(at, "checkout", "-qb", "side")
    put("side.txt", b"s\n", "side", "2024-01-06")
    run(at, "checkout", "-q", "main")
    put("main-only.txt", b"m\n", "main", "2024-01-07")
    run(at, "merge", "-q", "--no-ff", "-m", "merge", "side", day="2024-01-08")
    run(at, "rm", "-q", "main-only.txt")
    run(at, "commit", "-qm", "drop \x01 and \x02 bytes", day="2024-01-09", who="Bob")
    return at


@pytest.mark.parametrize("mode", ["names", "lines"])
def test_log_equals_git(spark, hostile, mode):
    rows = gitlog.read_log(spark, str(hostile), mode=mode).orderBy("seq").collect()
    assert [r.hash for r in rows] == gitlog.git(str(hostile), "log", "--all", "--format=%H").split()
    for r in rows:
        own = gitlog.git(str(hostile), "show", "-z", "--name-only", "--no-renames" if mode == "names" else "-M", "--format=", "-m" if False else "--first-parent", r.hash) if not r.merge else ""
        assert sorted(f.path for f in r.files) == sorted(p for p in own.split("\0") if p.strip("\n"))
    assert sum(r.merge for r in rows) == 1
    assert sum(not r.files for r in rows) == 2
    assert [r.subject for r in rows if r.author == "Bob"] == ["drop   and   bytes"]


def test_lines_renames_and_binaries(spark, hostile):
    files = {f.path: f for r in gitlog.read_log(spark, str(hostile), mode="lines").collect() for f in r.files if not (f.path == "main-only.txt" and f["del"] == 0)}
    assert (files["renamed.txt"].old_path, files["renamed.txt"].add, files["renamed.txt"]["del"], files["renamed.txt"].rename) == ("a.txt", 3, 0, True)
    assert files["img.bin"].binary and files["img.bin"].add is None
    assert files["main-only.txt"]["del"] == 1


def test_shards_partition_the_log(spark, hostile):
    whole = [r.hash for r in gitlog.read_log(spark, str(hostile)).orderBy("seq").collect()]
    parts = gitlog.read_log(spark, str(hostile), shard=3)
    assert parts.rdd.getNumPartitions() == -(-len(whole) // 3)
    assert [r.hash for r in parts.orderBy("seq").collect()] == whole
    assert gitlog.read_log(spark, str(hostile), max_count=4).count() == 4


def test_repository_lookup(repo, tmp_path):
    assert gitlog.discover(str(repo / "src"))["root"] == str(repo)
    assert gitlog.discover(str(tmp_path)) is None
    assert gitlog.head(str(repo))["branch"] == "main"
    assert gitlog.commit_count(str(repo)) == 6


@pytest.fixture(scope="module")
def doc(spark, repo):
    r = report.analyse(spark, str(repo), report.Options(lines=True, today="2024-09-15"))
    return r, report.to_json(r)


def test_graph(doc):
    r, d = doc
    s = {x.rel: x for x in r["signals"].collect()}
    assert (s["src/a.js"].fan_out, s["src/a.js"].fan_in, s["src/d.js"].fan_in, s["src/d.js"].fan_out) == (2, 0, 3, 0)
    assert d["structure"]["cycles"] == [["src/e.js", "src/f.js"]]
    assert (s["api/tests/test_user.py"].fan_out, s["api/svc/user.py"].fan_in) == (1, 1)
    assert s["src/d.js"].is_tested and s["api/svc/user.py"].is_tested and not s["src/a.js"].is_tested
    assert d["structure"]["undeclared"] == [{"name": "yaml", "importers": 1}] and d["structure"]["unused"] == ["flask"]


def test_scores(doc):
    r, d = doc
    assert abs(sum(RISK_WEIGHTS.values()) - 1) < 1e-9
    assert d["hotspots"][0]["path"] == "src/hot.js"
    assert {"churn", "complexity"} <= {x["key"] for x in d["hotspots"][0]["reasons"]}
    hot = r["signals"].where("rel = 'src/hot.js'").first()
    assert (hot.debt, hot.suppressed, hot.commits) == (2, 1, 6) and hot.complexity > 4
    assert {x["marker"]: x["count"] for x in d["debt"]["byType"]} == {"TODO": 1, "FIXME": 1}
    assert len(d["health"]["components"]) == 7 and all(0 <= c["value"] <= 100 for c in d["health"]["components"])
    assert d["ownership"]["busFactor"] == 1 and d["ownership"]["total"] == 1


def test_invariants(doc):
    r, d = doc
    months = d["timeline"]["months"]
    assert len(months) == 26 and months[-1]["month"] == "2024-09" and sum(m["commits"] for m in months) == d["history"]["commits"] == 6
    for key in ("files", "code", "comment", "blank", "decisions", "bytes", "debt"):
        assert sum(x[key] for x in d["languages"]) == d["totals"][key]
    parts = ["churn", "complexity_part", "size", "debt_part", "ownership", "blast_radius", "untested", "suppression"]
    for x in r["signals"].collect():
        assert abs(x.risk - min(100, sum(100 * w * x[p] for p, w in zip(parts, RISK_WEIGHTS.values(), strict=True)))) < 1e-6
    assert {"header", "health", "totals", "languages", "history", "tests", "debt", "ownership", "structure", "timeline", "hotspots"} <= {*d, "header"}
    text = report.render(d)
    assert "Hot files" in text and "src/hot.js" in text
    assert report.render(d, ["health"]).startswith("Health")


def test_cache_gives_the_same_and_reads_only_what_changed(spark, repo, tmp_path):
    records = workspace.kept(workspace.files(spark, str(repo)))
    cold = report.measure(spark, records, str(repo), None, "2024-09-15").orderBy("rel").collect()
    first = report.measure(spark, records, str(repo), str(tmp_path / "c"), "2024-09-15").orderBy("rel").collect()
    second = report.measure(spark, records, str(repo), str(tmp_path / "c"), "2024-09-15").orderBy("rel").collect()
    assert first == cold and [r.asDict() for r in second] == [r.asDict() for r in cold]
    assert spark.read.parquet(str(tmp_path / "c")).count() == len(cold)
    assert cli.prune(str(tmp_path / "c"), "2024-09-20") == 0
    assert cli.prune(str(tmp_path / "c"), "2024-10-20") > 0


def test_every_path_is_in_one_class(spark, repo):
    (repo / "node_modules").mkdir(exist_ok=True)
    (repo / "node_modules/x.js").write_text("1")
    (repo / "logo.png").write_bytes(b"\x89PNG")
    files = workspace.files(spark, str(repo), include_untracked=True, exclude=["legacy"])
    n = {r.skip or "kept": r["count"] for r in files.groupBy("skip").count().collect()}
    assert n == {"kept": len(FILES) - 1, "excluded": 1, "vendor": 1, "binary": 1}
    assert workspace.kept(files, "python").select(F.min("language"), F.max("language")).first() == ("Python", "Python")


def test_command_line(spark, repo, tmp_path, capsys):
    assert cli.main(["--sectoins=x"]) == 2 and "did you mean --sections" in capsys.readouterr().err
    assert cli.main(["--sections", "nope"]) == 2
    assert cli.main(["-C", str(tmp_path)]) == 2
    assert cli.main(["-V"]) == 0
    capsys.readouterr()
    code = cli.main(["-C", str(repo), "--json", "--fail-on", "A", "--today=2024-09-15"], spark)
    d = json.loads(capsys.readouterr().out)
    assert d["meta"]["schema"] == 1 and code == (1 if d["health"]["grade"] >= "A" else 0)


def test_repository_without_commits(spark, tmp_path):
    run(tmp_path, "init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run(tmp_path, "add", ".")
    d = report.to_json(report.analyse(spark, str(tmp_path), report.Options(today="2024-09-15")))
    assert d["history"]["commits"] == 0 and d["totals"]["files"] == 1 and d["ownership"]["busFactor"] == 0


def test_failing_log_raises(spark, repo):
    from pyspark.errors import PySparkException

    with pytest.raises((PySparkException, Exception), match="status"):
        gitlog.read_log(spark, str(repo), since="2024-01-01", pathspec=":(nonsense)x").collect()
    with pytest.raises(RuntimeError, match="git log ended"):
        list(gitlog.GitLogReader({"path": str(repo) + "/missing"}).read(gitlog.Shard(0, 0)))


def test_parser_does_not_look_at_a_commit_again():
    seen = []


    parser = gitlog.Parser()
    head = f"{gitlog.RECORD}{'a' * 40}{gitlog.FIELD}{gitlog.FIELD}A{gitlog.FIELD}a@x{gitlog.FIELD}2024-01-01{gitlog.FIELD}s\0"
    list(parser.feed(head))
    for i in range(50):
        list(parser.feed(f"path{i}\0" * 200))
        seen.append(len(parser.tail))
    assert max(seen) <= 70
    (commit,) = parser.close()
    assert len(commit[7]) == 50 * 200
