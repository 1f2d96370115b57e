"""What the queries of `samples` return, as SQL: values written by hand, or statements over the whole tables."""

from __future__ import annotations

from collections.abc import Iterable

from .oracle import _PATHS, _classified


def values(columns: str, rows: Iterable[tuple]) -> str:
    """A SELECT of the rows; columns is a list of names with types."""
    names = [c.split() for c in columns.split(", ")]

    def shown(x: object) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    picked = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names)
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({', '.join(n for n, _ in names)})"


_IMPORTS = {
    "JavaScript": ["pkg/sub", "./a", "side", "./late", "r"],
    "TypeScript": ["@scope/t", "../up"],
    "Python": ["a.b", ".", "os", "sys", "late"],
    "Go": ["one", "two", "x/three"],
    "Rust": ["std::fmt", "crate::a", "inner"],
    "Java": ["java.util.List", "a.B.c"],
    "Kotlin": ["a.b.C"],
    "C": ["stdio.h", "own.h"],
    "C++": ["vector"],
    "C#": ["System.Text", "A.B"],
    "Ruby": ["json", "lib/x"],
    "PHP": ["a.php", "b.php"],
    "Swift": ["Foundation"],
    "Scala": ["a.b.{C", "D}"],
    "Shell": ["./env.sh", "lib/x"],
    "Lua": ["a.b", "c"],
    "Elixir": ["Ecto.Query"],
    "Dart": ["package:a/b.dart"],
    "Vue": ["./A.vue"],
    "Svelte": ["./B.svelte"],
    "Zig": ["std"],
    "Haskell": ["Data.Map", "Prelude"],
}


def _options(bases: list[str]) -> list[str]:
    return [b + e for b in bases for e in ("", ".ts", ".py", "/index.ts")]


_CANDIDATES = [("src/ui/a.ts", "./b", ["src/ui/b"]), ("a/b/c.py", "x.y", ["a/b/x/y", "a/x/y", "x/y", "src/x/y"]), ("m.py", "n", ["n", "src/n"])]
_A, _B, _C = (c * 40 for c in "abc")

SQL = {
    "lexer_measures": values(
        "rel VARCHAR, language VARCHAR, skip VARCHAR, total INTEGER, code INTEGER, comment INTEGER, blank INTEGER, comments INTEGER, decisions INTEGER, depth INTEGER, funcs INTEGER, suppressed INTEGER, complexity INTEGER, bytes BIGINT",
        [
            ("src/app.js", "JavaScript", None, 10, 6, 3, 1, 3, 1, 4, 1, 0, 5, 192),
            ("src/lib/a.js", "JavaScript", None, 3, 3, 0, 0, 0, 0, 1, 1, 0, 0, 40),
            ("src/app.test.js", "JavaScript", None, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 25),
            ("tools/b.ts", "TypeScript", None, 3, 1, 2, 0, 2, 0, 1, 1, 2, 0, 54),
            ("pkg/util.py", "Python", None, 9, 6, 1, 2, 2, 4, 2, 2, 1, 0, 160),
            ("cmd/main.go", "Go", None, 9, 7, 0, 2, 0, 3, 3, 1, 0, 1, 77),
            ("Main.java", "Java", None, 3, 3, 0, 0, 0, 0, 2, 1, 0, 0, 80),
            ("conf.yml", "YAML", None, 3, 1, 1, 1, 2, 0, 0, 0, 0, 0, 14),
            ("lib.rs", "Rust", None, 2, 2, 0, 0, 0, 2, 3, 1, 0, 1, 46),
            ("notes.xyz", None, "unknown-language", 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 8),
            ("data.js", "JavaScript", "binary", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3),
            ("gone.js", "JavaScript", "missing", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
            ("empty.css", "CSS", None, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        ],
    ),
    "lexer_debt": values("rel VARCHAR, place INTEGER, line INTEGER, marker VARCHAR, weight INTEGER", [("src/app.js", 0, 4, "FIXME", 3), ("src/app.js", 1, 1, "TODO", 2), ("pkg/util.py", 0, 9, "TODO", 2), ("pkg/util.py", 1, 9, "TODO", 2)]),
    "lexer_of_documents": """
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS s FROM documents WHERE text <> ''),
m AS (SELECT doc_id, regexp_matches(s, '^[^#]*[^#\\s]') AS code, contains(s, '#') AS said FROM l),
n AS (SELECT doc_id, count(*) AS total, count(*) FILTER (code) AS code, count(*) FILTER (said AND NOT code) AS comment, count(*) FILTER (NOT said AND NOT code) AS blank, count(*) FILTER (said) AS comments FROM m GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS rel, CAST(coalesce(total, 0) AS INTEGER) AS total, CAST(coalesce(code, 0) AS INTEGER) AS code, CAST(coalesce(comment, 0) AS INTEGER) AS comment,
  CAST(coalesce(blank, 0) AS INTEGER) AS blank, CAST(coalesce(comments, 0) AS INTEGER) AS comments FROM documents LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL""",
    "unknown_language_lines": """SELECT CAST(page_id AS VARCHAR) AS rel, CAST(length(html) - length(replace(html, chr(10), '')) + CASE WHEN html = '' OR suffix(html, chr(10)) THEN 0 ELSE 1 END AS INTEGER) AS total,
CAST(0 AS INTEGER) AS code FROM pages WHERE html IS NOT NULL""",
    "lexer_imports": values("language VARCHAR, place INTEGER, spec VARCHAR", [(name, i, s) for name, specs in _IMPORTS.items() for i, s in enumerate(specs)]),
    "lexer_suppressions": values("language VARCHAR, suppressed INTEGER, comments INTEGER", [("JavaScript", 2, 3), ("Python", 3, 3), ("Go", 1, 2)]),
    "import_paths": values(
        "importer VARCHAR, spec VARCHAR, joined VARCHAR, relative VARCHAR, clean VARCHAR, package VARCHAR",
        [
            ("src/a/x.ts", "../b/./c.js", "src/b/c.js", "src/b/c.js", "../b/./c.js", ".."),
            ("x.js", "../../y.js", "y.js", None, "../../y.js", ".."),
            ("a/b.js", "./", "a", "a", "./", "."),
            ("a/b.js", "lodash/fp", "a/lodash/fp", None, "lodash/fp", "lodash"),
            ("a/b.js", "@/c", "a/@/c", None, "./c", "@/c"),
            ("a/b.js", "~lib/d", "a/~lib/d", None, "./lib/d", "~lib"),
            ("a/b.js", "node:fs", "a/node:fs", None, "fs", "fs"),
            ("a/b.js", "dart:io", "a/dart:io", None, None, "dart"),
            ("a/b.js", "package:http/http.dart", "a/package:http/http.dart", None, "http/http.dart", "http"),
            ("a/b.js", "@org/kit/x", "a/@org/kit/x", None, "@org/kit/x", "@org/kit"),
            ("a/b.js", "https://x.y/z", "a/https:/x.y/z", None, "https://x.y/z", "https"),
            ("a/b.js", "#in", "a/#in", None, "./in", None),
            ("a/b.js", "odd word", "a/odd word", None, "odd word", None),
            ("a/b.js", "", "a", None, None, None),
        ],
    ),
    "import_candidates": values("importer VARCHAR, spec VARCHAR, place INTEGER, path VARCHAR", [(i, s, n, p) for i, s, bases in _CANDIDATES for n, p in enumerate(_options(bases))]),
    "tree_probes": values("kind VARCHAR, place INTEGER, value VARCHAR", [("ext", 0, ".ts"), ("ext", 1, ".py"), ("index", 0, "index.ts")]),
    "tree_resolved": values(
        "src VARCHAR, spec VARCHAR, target VARCHAR",
        [
            ("Main.java", "a.B.c", None), ("Main.java", "java.util.List", None), ("cmd/main.go", "fmt", None), ("lib.rs", "std::fmt", None), ("pkg/util.py", ".base", None), ("pkg/util.py", "os", None),
            ("pkg/util.py", "sys", None), ("src/app.js", "../tools/b", "tools/b.ts"), ("src/app.js", "./lib/a.js", "src/lib/a.js"), ("src/app.test.js", "./app", "src/app.js"),
        ],
    ),
    "tree_edges": values("src VARCHAR, dst VARCHAR", [("src/app.js", "tools/b.ts"), ("src/app.test.js", "src/app.js"), ("src/app.js", "src/lib/a.js")]),
    "test_stems": values(
        "path VARCHAR, stem VARCHAR, with_extension VARCHAR",
        [
            ("src/a.test.ts", "src/a", "src/a.ts"), ("src/a.spec.jsx", "src/a", "src/a.jsx"), ("lib/tests/b.py", "lib/b.py", "lib/b.py"), ("pkg/test_c.py", "pkg/c.py", "pkg/c.py"),
            ("pkg/d_test.go", "pkg/d", "pkg/d.go"), ("e/test.js", "e", "e"), ("src/__tests__/f.js", "src/f.js", "src/f.js"), ("g.py", "g.py", "g.py"),
        ],
    ),
    "tested_by_name": values("rel VARCHAR, rule VARCHAR", [(r, "plain") for r in ("far.py", "lib/b.py", "pkg/c.py")] + [(r, "with extension") for r in ("far.py", "lib/b.py", "pkg/c.py", "src/a.ts")]),
    "languages_kept": f"WITH {_classified('???')} SELECT rel, size FROM cl WHERE skip IS NULL AND language = 'TypeScript'",
    "hot_file_search": f"WITH {_PATHS} SELECT rel FROM paths WHERE contains(lower(rel), 'p12')",
    "days_and_months": values(
        "d VARCHAR, day INTEGER, bucket VARCHAR",
        [("1970-01-01", 0, "1970-01"), ("1970-03-01", 59, "1970-03"), ("2000-02-29", 11016, "2000-02"), ("2024-13-40", 0, "2024-13"), ("", 0, "unknown"), (None, 0, "unknown"), ("1999", 0, "unknown")],
    ),
    "recency_buckets": values(
        "days INTEGER, recency VARCHAR, label VARCHAR",
        [
            (0, "this week", "active"), (7, "this week", "active"), (8, "this month", "active"), (30, "this month", "active"), (31, "3 months", "recent"), (90, "3 months", "recent"), (91, "a year", "recent"),
            (180, "a year", "recent"), (181, "a year", "lurking"), (365, "a year", "lurking"), (366, "2 years", "dormant"), (730, "2 years", "dormant"), (731, "3+ years", "dormant"),
        ],
    ),
    "rounding": values("v DOUBLE, rounded BIGINT, clamped DOUBLE, grade VARCHAR", [(-1.5, -1, 0.0, "E"), (-0.4, 0, 0.0, "E"), (0.5, 1, 0.5, "E"), (1.49, 1, 1.0, "E"), (2.5, 3, 1.0, "E"), (84.99, 85, 1.0, "B")]),
    "python_names": values("name VARCHAR, normal VARCHAR", [("My_Pkg", "my-pkg"), ("a-b", "a-b"), ("A__b", "a--b")]),
    "log_records": values(
        "mode VARCHAR, seq BIGINT, hash VARCHAR, author VARCHAR, email VARCHAR, date VARCHAR, merge BOOLEAN, subject VARCHAR, path VARCHAR, old_path VARCHAR, add INTEGER, dele INTEGER, binary BOOLEAN, rename BOOLEAN",
        [
            ("names", 0, _A, "Ann", "ann@x.org", "2024-02-03", False, "one", "new.py", None, None, None, False, False),
            ("names", 0, _A, "Ann", "ann@x.org", "2024-02-03", False, "one", "src/a b.py", None, None, None, False, False),
            ("names", 1, _B, "Bob", "bob@x.org", "2024-02-01", False, "odd subject", "x", None, None, None, False, False),
            ("lines", 0, _A, "Ann", "ann@x.org", "2024-02-03", True, "merge", "x.py", None, 3, 1, False, False),
            ("lines", 0, _A, "Ann", "ann@x.org", "2024-02-03", True, "merge", "pic.png", None, None, None, True, False),
            ("lines", 0, _A, "Ann", "ann@x.org", "2024-02-03", True, "merge", "new.py", "old.py", 0, 2, False, True),
            ("lines", 1, _C, "Cid", "cid@x.org", "2024-01-01", False, "empty", None, None, None, None, False, False),
        ],
    ).replace("CAST(binary AS BOOLEAN) AS binary", 'CAST("binary" AS BOOLEAN) AS "binary"').replace("dele, binary,", 'dele, "binary",'),
    "manifest_names": values(
        "file VARCHAR, kind VARCHAR, name VARCHAR, is_dev BOOLEAN",
        [
            ("package.json", "npm", "react", False), ("package.json", "npm", "@a/b", False), ("package.json", "npm", "jest", True), ("requirements.txt", "pip", "flask-login", False), ("requirements.txt", "pip", "numpy", False),
            ("requirements.txt", "pip", "requests", False), ("go.mod", "go", "example.com/x", False), ("go.mod", "go", "github.com/a/b", False), ("Cargo.toml", "cargo", "serde", False), ("Cargo.toml", "cargo", "rand_core", False),
            ("Gemfile", "bundler", "rails", False), ("Gemfile", "bundler", "puma", False), ("pyproject.toml", "pypi", "django", False), ("pyproject.toml", "pypi", "typing-ext", False),
        ],
    ),
    "rename_matches": values("path VARCHAR, inferred_from VARCHAR", [("new/a.py", "old/a.py")]),
    "rename_folded": values(
        "path VARCHAR, commits BIGINT, adds BIGINT, dels BIGINT, inferred_from VARCHAR",
        [("new/a.py", 4, 21, 3, "old/a.py"), ("old/a.py", 2, 12, 2, None), ("new/a.pyx", 1, 1, 0, None), ("old/b.py", 1, 3, 1, None), ("new/c.py", 1, 1, 0, None), ("old/z.py", 1, 1, 0, None), ("keep.py", 1, 1, 1, None)],
    ),
    "author_files_folded": values("key VARCHAR, files BIGINT", [("ann", 4), ("bob", 5)]),
    "month_files_folded": values("bucket VARCHAR, files BIGINT", [("1970-01", 4), ("1970-02", 4), ("1970-03", 2)]),
}
