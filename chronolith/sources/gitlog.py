"""The commit log as a data source: `spark.read.format("gitlog")` runs git and parses its record stream.

Records are framed by control bytes: \\x01 begins a commit, \\x02 parts its header fields,
its subject ends at the first line feed or NUL, and NUL-ended tokens follow for its files.
"""

from __future__ import annotations

import codecs
import re
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import COMMIT

# Framing of the log stream.
RECORD, FIELD = "\x01", "\x02"
#: A record's subject may hold the framing byte itself, so records begin where a hash follows, of at most 64 digits.
_BEGIN, _REACH = re.compile(rf"(?<=[\0\n]){RECORD}(?=[0-9a-f]{{40,64}}{FIELD})"), 66
FORMAT = f"{RECORD}%H{FIELD}%P{FIELD}%an{FIELD}%ae{FIELD}%ad{FIELD}%s"


def git(cwd: str, *args: str) -> str:
    return subprocess.run(["git", "-C", cwd, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def discover(start: str) -> dict[str, Any] | None:
    """root, git_dir and bare of the repository around a path; None outside of one."""
    try:
        lines = git(start, "rev-parse", "--is-bare-repository", "--absolute-git-dir").splitlines()
        bare = lines[0] == "true"
        return {"root": lines[1] if bare else git(start, "rev-parse", "--show-toplevel").strip(), "git_dir": lines[1], "bare": bare}
    except (subprocess.CalledProcessError, FileNotFoundError):
        return None


def head(cwd: str) -> dict[str, str]:
    """hash, date, author, refs and branch of the current commit; empty before the first."""
    try:
        h, date, author, refs = git(cwd, "log", "-1", f"--format=%H{FIELD}%ad{FIELD}%an{FIELD}%D", "--date=iso").rstrip("\n").split(FIELD)
    except subprocess.CalledProcessError:
        return {}
    branch = git(cwd, "rev-parse", "--abbrev-ref", "HEAD").strip()
    if branch == "HEAD":
        try:
            branch = git(cwd, "describe", "--all", "--exact-match").strip()
        except subprocess.CalledProcessError:
            branch = "detached"
    return {"hash": h, "date": date, "author": author, "refs": refs, "branch": branch}


def commit_count(cwd: str) -> int:
    return int(git(cwd, "rev-list", "--all", "--count") or 0)


@dataclass
class Parser:
    """Turns chunks of the log stream into commits (tuples of the commit relation); a commit is ready when the next begins."""

    lines: bool = False
    seq: int = 0
    begun: bool = False
    held: list[str] = field(default_factory=list)
    tail: str = "\n"  # one character that is read already, and what may be a cut begin

    def feed(self, chunk: str) -> Iterator[tuple]:
        """The commits that end in the chunk; of one that goes on only its last characters are looked at again."""
        text, at = self.tail + chunk, 1
        for m in _BEGIN.finditer(text):
            if self.begun:
                yield self.record("".join([*self.held, text[at : m.start()]]))
            self.held, self.begun, at = [], True, m.end()
        keep = max(at, len(text) - _REACH)
        if self.begun:
            self.held.append(text[at:keep])
        self.tail = text[keep - 1 :]

    def close(self) -> Iterator[tuple]:
        if self.begun:
            yield self.record("".join([*self.held, self.tail[1:]]))
        self.held, self.begun, self.tail = [], False, "\n"

    def record(self, text: str) -> tuple:
        h, parents, author, email, date, tail = text.split(FIELD, 5)
        end = min((i for i in (tail.find("\n"), tail.find("\0")) if i >= 0), default=len(tail))
        subject, body = tail[:end], tail[end:].lstrip("\n\0")
        if RECORD in subject or FIELD in subject:
            subject = re.sub(r"[\x00-\x1f]", " ", subject)
        out = (self.seq, h, author, email, date, len(parents.split()) > 1, subject, self.files([t.lstrip("\n") for t in body.split("\0")]))
        self.seq += 1
        return out

    def files(self, tokens: list[str]) -> list[tuple]:
        """Files of a commit; in lines mode `added TAB deleted TAB path`, an empty path being followed by the old and the new one."""
        out: list[tuple] = []
        it = iter(t for t in tokens)
        for t in it:
            if not t:
                continue
            if not self.lines:
                out.append((t, None, None, None, False, False))
                continue
            add, dele, path = t.split("\t", 2)
            binary = add == "-"
            old = None
            if not path:
                old, path = next(it), next(it)
            out.append((path, old, None if binary else int(add), None if binary else int(dele), binary, old is not None))
        return out


@dataclass
class Shard(InputPartition):
    """Commits skip..skip + count of the log; count 0 means all that follow."""

    skip: int
    count: int


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = options

    def flags(self) -> list[str]:
        o = self.o
        out = ["log", "--date=short", f"--format={FORMAT}", "-z"]
        if o.get("mode", "names") == "lines":
            out += ["--numstat", *(["-M"] if o.get("renames", "true") == "true" else ["--no-renames"])]
        else:
            out += ["--name-only", "--no-renames"]
        if o.get("all", "true") == "true":
            out.append("--all")
        return out + [f"--{k}={o[k]}" for k in ("since", "until") if k in o]

    def partitions(self) -> list[Shard]:
        most, size = int(self.o.get("max_count", 0)), int(self.o.get("shard", 0))
        if not size:
            return [Shard(0, most)]
        total = commit_count(self.o["path"])
        total = min(total, most) if most else total
        return [Shard(i, min(size, total - i)) for i in range(0, total, size)] or [Shard(0, 0)]

    def read(self, shard: Shard) -> Iterator[tuple]:
        args = [*self.flags(), f"--skip={shard.skip}", *([f"--max-count={shard.count}"] if shard.count else [])]
        paths = ["--", self.o["pathspec"]] if "pathspec" in self.o else []
        parser = Parser(lines=self.o.get("mode") == "lines", seq=shard.skip)
        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        with tempfile.TemporaryFile() as said:
            p = subprocess.Popen(["git", "-C", self.o["path"], *args, *paths], stdout=subprocess.PIPE, stderr=said)
            whole = False
            try:
                while chunk := p.stdout.read(1 << 16):
                    yield from parser.feed(decode(chunk))
                whole = True
            finally:
                if not whole:
                    p.kill()
                p.stdout.close()
                status = p.wait()
            said.seek(0)
            message = said.read().decode("utf-8", "replace").strip()
        # a log that broke off is no history
        if status and "does not have any commits yet" not in message:
            raise RuntimeError(f"git log ended with status {status}: {message}")
        yield from parser.close()


class GitLog(DataSource):
    """Options: path; mode names or lines; renames, all, since, until, max_count, pathspec; shard (commits a partition).

    The repository has to be at the path on every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> T.StructType:
        return COMMIT

    def reader(self, schema: T.StructType) -> GitLogReader:
        return GitLogReader(dict(self.options))


def read_log(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The commit relation of a repository; seq 0 is the newest commit."""
    spark.dataSource.register(GitLog)
    r = spark.read.format("gitlog").option("path", path)
    for k, v in options.items():
        if v is not None:
            r = r.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return r.load()
