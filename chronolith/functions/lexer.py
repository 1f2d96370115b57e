"""The lexer: line census, nesting, decisions, definitions, imports, debt and suppressions of a source text.

`measure` is a plain function of text and language; `scan` runs it over a DataFrame in
Arrow batches.  A text is tokenised by one compiled pattern a language, whose matches are
comments, strings and single characters of structure; what lies between is code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import registry as R
from ..schema import SHAPE

_OPERATORS = re.compile(r"\?(?!:)|&&|\|\|")
_FIELDS = ("total", "code", "comment", "blank", "comments", "decisions", "depth", "funcs", "suppressed", "complexity")


@cache
def _tokens(language: str) -> re.Pattern[str]:
    """Comments before strings, line comments before block comments; a line comment is known by its first two characters."""
    x = R.BY_NAME[language]
    parts = []
    if x.line:
        parts.append(rf"(?P<line>{re.escape(x.line[:2])}[^\n]*)")
    if x.block:
        parts.append(rf"(?P<block>{re.escape(x.block[0])}(?s:.*?)(?:{re.escape(x.block[1])}|\Z))")
    for i, q in enumerate(x.quotes):
        e = re.escape(q)
        # a string other than a template ends with its line
        inner = rf"(?:\\(?s:.)|[^\\{e}])*+(?:{e}|\Z)" if q == "`" else rf"(?:\\(?s:.)|[^\\\n{e}])*+(?:{e}|(?=\n)|\Z)"
        parts.append(rf"(?P<str{i}>{e}{inner})")
    parts.append(r"(?P<line_feed>\n)")
    return re.compile("|".join(parts))


@cache
def _keywords(language: str) -> list[re.Pattern[str]]:
    return [re.compile(R.keyword_pattern(k)) for k in R.KEYWORDS[R.family(language)]]


@cache
def _patterns(language: str, kind: str) -> list[re.Pattern[str]]:
    return [re.compile(p) for p in (R.definition_patterns(language) if kind == "definitions" else R.BY_NAME[language].imports)]


_SUPPRESSION = re.compile(R.SUPPRESSION)


def split_text(text: str, language: str) -> tuple[str, str, list[tuple[int, str]], list[tuple[bool, bool]]]:
    """Code without comments and strings, code with strings, comments as (line, text), and (has code, has comment) of each line."""
    code, kept, comments = [], [], []
    lines = [[False, False]]
    at = 0

    def plain(piece: str) -> None:
        code.append(piece)
        kept.append(piece)
        if piece.strip():
            lines[-1][0] = True

    for m in _tokens(language).finditer(text):
        plain(text[at : m.start()])
        at = m.end()
        kind, token = m.lastgroup, m[0]
        if kind == "line_feed":
            code.append("\n")
            kept.append("\n")
            lines.append([False, False])
            continue
        breaks = token.count("\n")
        if kind in ("line", "block"):
            comments.append((len(lines), token))
            lines[-1][1] = True
            for _ in range(breaks):
                lines.append([False, True])
        else:
            kept.append(token)
            for _ in range(breaks):
                lines.append([False, False])
        code.append("\n" * breaks or " ")
        if kind in ("line", "block"):
            kept.append("\n" * breaks or " ")
    plain(text[at:])
    if lines and text.endswith("\n"):
        lines.pop()
    return "".join(code), "".join(kept), comments, [(a, b) for a, b in lines] if text else []


def nesting(code: str) -> int:
    deep = most = 0
    for c in code:
        if c in "{[(":
            deep += 1
            most = max(most, deep)
        elif c in "}])":
            deep = max(0, deep - 1)
    return most


def debt_of(comments: list[tuple[int, str]]) -> list[dict[str, Any]]:
    """A row for each label in upper-cased comment text, heaviest first; none beyond DEBT_CAP."""
    out = []
    for first, text in comments:
        for i, line in enumerate(text.split("\n")):
            up = line.upper()
            for label, weight in R.DEBT.items():
                for _ in range(up.count(label)):
                    if len(out) < R.DEBT_CAP:
                        out.append({"line": first + i, "marker": label, "text": line.strip()[:90], "weight": weight})
    return sorted(out, key=lambda d: -d["weight"])


def imports_of(kept: str, language: str) -> list[str]:
    found: dict[str, None] = {}
    for p in _patterns(language, "imports"):
        for n, m in enumerate(p.finditer(kept)):
            if n >= R.IMPORT_CAP:
                break
            for piece in m[1].split(","):
                name = re.sub(r"\s+as\s+.*$", "", piece.strip(), flags=re.S)
                if name:
                    found[name] = None
    return list(found)


def measure(text: str, language: str) -> dict[str, Any]:
    """All measures of a text in a known language."""
    x = R.BY_NAME[language]
    code, kept, comments, lines = split_text(text, language)
    n_code = sum(a for a, _ in lines)
    n_comment = sum(b and not a for a, b in lines)
    operators = len(_OPERATORS.findall(code))
    deep = nesting(code)
    out: dict[str, Any] = {
        "total": len(lines), "code": n_code, "comment": n_comment, "blank": len(lines) - n_code - n_comment,
        "comments": sum(t.count("\n") + 1 for _, t in comments), "depth": deep,
        "suppressed": sum(len(_SUPPRESSION.findall(t)) for _, t in comments),
        "complexity": operators + max(0, deep - 2), "decisions": 0, "funcs": 0, "debt": debt_of(comments), "imports": [],
    }
    if x.data:
        out["complexity"] = 0
        return out
    if code.strip():
        words = min(R.DECISION_CAP, sum(len(p.findall(code)) for p in _keywords(language)))
        out["decisions"] = words + min(R.OPERATOR_SHARE_CAP, operators >> 4)
        out["funcs"] = min(R.DEFINITION_CAP, sum(sum(1 for _ in p.finditer(code)) for p in _patterns(language, "definitions")))
        out["imports"] = imports_of(kept, language)
    return out


def count_lines(text: str) -> int:
    return text.count("\n") + (0 if not text or text.endswith("\n") else 1)


def looks_binary(content: bytes) -> bool:
    """A NUL in the first bytes, or a broken character among the first three."""
    return b"\0" in content[: R.SNIFF_BYTES] or "�" in content[:64].decode("utf-8", "replace")[:3]


def shape_of(rel: str, content: bytes | None, language: str | None) -> dict[str, Any]:
    """A row of the shape relation; a text that fails to be measured has all zeros and the error."""
    row: dict[str, Any] = {"rel": rel, "language": language, "skip": None, "bytes": len(content or b""), "debt": [], "imports": [], "error": None, **dict.fromkeys(_FIELDS, 0)}
    if content is None:
        return row | {"skip": "missing"}
    if looks_binary(content):
        return row | {"skip": "binary"}
    text = content.decode("utf-8", "replace")
    if language not in R.BY_NAME:
        return row | {"skip": "unknown-language", "total": count_lines(text)}
    try:
        return row | measure(text, language)
    except (re.error, RecursionError) as e:
        return row | {"error": str(e)}


def scan(files: DataFrame, rel: str = "rel", content: str = "content", language: str = "language") -> DataFrame:
    """Shapes of all files (rel, content, language): one Arrow pass without a shuffle; filter languages before it."""
    schema = SHAPE


    arrow = to_arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shape_of(*x) for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select(F.col(rel).alias("rel"), F.col(content).cast("binary").alias("content"), F.col(language).alias("language")).mapInArrow(go, schema)
