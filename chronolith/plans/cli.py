"""Command line: `python -m chronolith.plans.cli --repo PATH`."""

from __future__ import annotations

import argparse
import difflib
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from ..registry import GRADES
from ..sources import gitlog
from . import report as R

LETTERS = [*(g for _, g in GRADES), "E"]


class UsageError(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise UsageError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="chronolith", description="Analyses the history, text and structure of a repository.", allow_abbrev=False)
    a = p.add_argument
    a("-V", "--version", action="store_true", help="print the version")
    a("-C", "--repo", default=".", help="repository to analyse")
    a("--json", action="store_true", help="emit the report as JSON")
    a("-t", "--tui", action="store_true", help="search hot files and authors for each line of input")
    a("-w", "--watch", action="store_true", help="analyse again when the index changes")
    a("--since")
    a("--until")
    a("--all", action=argparse.BooleanOptionalAction, default=True, help="every ref instead of HEAD only")
    a("--lines", action="store_true", help="count lines of changes")
    a("--max-commits", type=int)
    a("--top", type=int, default=20, help="rows a section")
    a("--sections", help="comma list of: " + ",".join(R.SECTIONS))
    a("--lang", help="one language only")
    a("--path", help="a pathspec")
    a("--include-untracked", action="store_true")
    a("--include-vendor", action="store_true")
    a("--exclude", action="append", default=[], help="skip paths with a substring; may be repeated")
    a("--no-cache", action="store_true")
    a("--cache-dir")
    a("--prune", action="store_true", help="delete cache partitions older than 14 days")
    a("--concurrency", type=int, default=0, help="local executor threads (0: all)")
    a("--no-color", action="store_true")
    a("--color", choices=["auto", "always", "never"], default="auto")
    a("--unicode", choices=["auto", "always", "never"], default="auto")
    a("--width", type=int)
    a("--profile", action="store_true", help="print seconds to stderr")
    a("-q", "--quiet", action="store_true")
    a("--fail-on", help="exit 1 if the grade is this letter or worse")
    a("--today", help="the day that ages are counted to")
    return p


def parse(argv: Sequence[str]) -> argparse.Namespace:
    p = parser()
    known = [s for x in p._actions for s in x.option_strings]
    for arg in argv:
        if arg == "--":
            break
        name = arg.split("=")[0]
        if name.startswith("--") and name not in known:
            near = difflib.get_close_matches(name, known, 1)
            raise UsageError(f"unknown flag {name}" + (f"; did you mean {near[0]}?" if near else ""))
    o = p.parse_args([a for a in argv if a != "--"])
    if o.sections and (odd := set(o.sections.split(",")) - set(R.SECTIONS)):
        raise UsageError(f"unknown section {sorted(odd)[0]}")
    if o.fail_on and o.fail_on[:1].upper() not in LETTERS:
        raise UsageError("--fail-on expects a letter A-E")
    return o


def prune(cache_dir: str, today: str, days: int = 14) -> int:
    """Deletes cache partitions of days more than `days` before today; returns how many."""
    import datetime
    import shutil

    oldest = (datetime.date.fromisoformat(today) - datetime.timedelta(days=days)).isoformat()
    gone = [p for p in Path(cache_dir).glob("shard=*/day=*") if p.name[4:] < oldest]
    for p in gone:
        shutil.rmtree(p)
    return len(gone)


def run(spark: SparkSession, o: argparse.Namespace, root: str) -> tuple[dict, int]:
    began = time.time()
    cache_dir = None if o.no_cache else o.cache_dir
    options = R.Options(o.since, o.until, o.all, o.lines, o.max_commits, o.top, o.lang, o.path, o.include_untracked, o.include_vendor, o.exclude, cache_dir, o.today)
    doc = R.to_json(R.analyse(spark, root, options))
    print(R.dumps(doc) if o.json else R.render(doc, o.sections.split(",") if o.sections else R.SECTIONS, o.top), end="" if not o.json else "\n")
    if o.profile:
        print(f"total {time.time() - began:.1f} s", file=sys.stderr)
    failed = o.fail_on and LETTERS.index(doc["health"]["grade"]) >= LETTERS.index(o.fail_on[0].upper())
    return doc, int(bool(failed))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if --fail-on says so, or 2 for usage errors and paths outside of a repository."""
    try:
        o = parse(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        print(f"chronolith: {e}", file=sys.stderr)
        return 2
    if o.version:
        print(R.VERSION)
        return 0
    if o.prune:
        import datetime

        print(prune(o.cache_dir or ".", o.today or datetime.date.today().isoformat()))
        return 0
    found = gitlog.discover(o.repo)
    if found is None:
        print(f"chronolith: {o.repo} is not in a repository", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.master(f"local[{o.concurrency or '*'}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    doc, code = run(spark, o, found["root"])
    if o.tui:
        for line in sys.stdin:
            needle = line.strip().lower()
            for x in doc["hotspots"]:
                if needle in x["path"].lower():
                    print(x["risk"], x["path"])
            for a in doc["ownership"]["authors"]:
                if needle in a["name"].lower() or needle in a["key"]:
                    print(a["commits"], a["name"])
    last = _stamp(found["git_dir"])
    while o.watch:
        time.sleep(0.75)
        if (now := _stamp(found["git_dir"])) != last:
            last = now
            doc, code = run(spark, o, found["root"])
    return code


def _stamp(git_dir: str) -> tuple[int, int] | None:
    """Time and size of the index, which every staging and commit changes."""
    try:
        s = (Path(git_dir) / "index").stat()
        return s.st_mtime_ns, s.st_size
    except OSError:
        return None


if __name__ == "__main__":
    sys.exit(main())
