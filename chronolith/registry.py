"""Languages, path classes, markers, package sets and weights.

Everything in capitals is a fixed value: results depend on it as stated.
"""

from __future__ import annotations

from dataclasses import dataclass

# Test path patterns that several languages share.
_TESTS = r"(?i)(^|[/._-])tests?([/._-]|$)"
_TESTS_OR_SPEC = r"(?i)(^|[/._-])(tests?|spec)([/._-]|$)"
_SPECS = r"(?i)(^|[/._-])specs?([/._-]|$)"
_JS_TESTS = r"(?i)(^|[/._-])(tests?|__tests__|spec|specs)([/._-]|$)"
_QUOTED_FROM = r"""\bfrom\s+['"]([^'"]+)['"]"""
_QUOTED_IMPORT = r"""\bimport\s+['"]([^'"]+)['"]"""
_IMPORT_CALL = r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)"""
_REQUIRE = r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""
_REQUIRE_RESOLVE = r"""\brequire\.resolve\(\s*['"]([^'"]+)['"]"""
_INCLUDE = r"""#\s*include\s*[<"]([^>"]+)[>"]"""


@dataclass(frozen=True)
class Language:
    """A language: patterns take group 1; data languages have no control flow."""

    name: str
    exts: tuple[str, ...]
    line: str | None = None
    block: tuple[str, str] | None = None
    quotes: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    data: bool = False


C_BLOCK, XML_BLOCK = ("/*", "*/"), ("<!--", "-->")
# The languages, in order of precedence.
LANGUAGES = (
    Language("JavaScript", (".js", ".jsx", ".mjs", ".cjs"), "//", C_BLOCK, ('"', "'", "`"), (_REQUIRE, _QUOTED_FROM, _QUOTED_IMPORT, _IMPORT_CALL, _REQUIRE_RESOLVE), (_JS_TESTS, r"(?i)\.(test|spec)\.[cm]?[jt]sx?$")),
    Language("TypeScript", (".ts", ".tsx", ".mts", ".cts"), "//", C_BLOCK, ('"', "'", "`"), (_QUOTED_FROM, _QUOTED_IMPORT, _IMPORT_CALL, _REQUIRE, _REQUIRE_RESOLVE), (_JS_TESTS, r"(?i)\.(test|spec)\.[cm]?tsx?$")),
    Language("Python", (".py", ".pyi", ".pyx"), "#", None, ('"', "'"), (r"(?m)^\s*from\s+([.\w]+)\s+import\b", r"(?m)^\s*import\s+([.\w]+(?:\s*,\s*[.\w]+)*)"), (r"(?i)(^|[/._-])(tests?|testing|spec)([/._-]|$)", r"(?i)(^|[/._-])test_[^/]*\.py$", r"(?i)_test\.py$")),
    Language("Go", (".go",), "//", C_BLOCK, ('"', "`"), (r'(?:^|\s)import\s+"([^"]+)"', r'\bimport\s*\(\s*"([^"]+)"', r'(?m)\s"([^"]+)"\s*$'), (r"(?i)_test\.go$",)),
    Language("Rust", (".rs",), "//", C_BLOCK, ('"',), (r"\buse\s+([\w:]+)", r"\bmod\s+([\w]+)\s*;"), (r"(?i)[/\\]tests?[/\\]",)),
    Language("Java", (".java",), "//", C_BLOCK, ('"',), (r"\bimport\s+(?:static\s+)?([\w.]+)",), (_TESTS, r"Test\.java$")),
    Language("Kotlin", (".kt", ".kts"), "//", C_BLOCK, ('"',), (r"\bimport\s+([\w.]+)",), (_TESTS, r"Test\.kt$")),
    Language("C", (".c", ".h"), "//", C_BLOCK, ('"', "'"), (_INCLUDE,), (_TESTS, r"_test\.c$")),
    Language("C++", (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), "//", C_BLOCK, ('"', "'"), (_INCLUDE,), (_TESTS, r"_test\.cpp$", r"Test\.cpp$")),
    Language("C#", (".cs", ".csx"), "//", C_BLOCK, ('"',), (r"\busing\s+(?:static\s+)?([\w.]+)",), (_TESTS, r"Tests\.cs$")),
    Language("Ruby", (".rb", ".rake", ".gemspec"), "#", ("=begin", "=end"), ('"', "'"), (r"""\brequire(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]""",), (_TESTS_OR_SPEC, r"_spec\.rb$")),
    Language("PHP", (".php",), "//", C_BLOCK, ('"', "'"), (r"""\b(?:use|require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]""",), (_TESTS, r"Test\.php$")),
    Language("Swift", (".swift",), "//", C_BLOCK, ('"',), (r"\bimport\s+([\w.]+)",), (r"(^|[/._-])Tests?([/._-]|$)",)),
    Language("Scala", (".scala", ".sc"), "//", C_BLOCK, ('"',), (r"\bimport\s+([\w.{}, _]+)",), (_SPECS, r"Spec\.scala$")),
    Language("Shell", (".sh", ".bash", ".zsh", ".fish", ".ksh"), "#", None, ('"', "'"), (r"(?m)(?:^|\s)(?:source|\.)\s+([./\w-]+)",), (_TESTS, r"\.?(test|spec)\.sh$")),
    Language("Lua", (".lua",), "--", ("--[[", "]]"), ('"', "'"), (r"""\brequire\s*\(?\s*['"]([^'"]+)['"]""",), (_SPECS, r"_spec\.lua$")),
    Language("Elixir", (".ex", ".exs"), "#", None, ('"', "'"), (r"\bimport\s+([\w.]+)",), (r"(?i)(^|[/._-])test([/._-]|$)", r"_test\.exs$")),
    Language("Dart", (".dart",), "//", C_BLOCK, ('"', "'"), (_QUOTED_IMPORT,), (r"(?i)(^|[/._-])test([/._-]|$)", r"_test\.dart$")),
    Language("Vue", (".vue",), "//", XML_BLOCK, ('"', "'", "`"), (_QUOTED_FROM,), (_TESTS_OR_SPEC,)),
    Language("Svelte", (".svelte",), "//", XML_BLOCK, ('"', "'", "`"), (_QUOTED_FROM,), (_TESTS_OR_SPEC,)),
    Language("Zig", (".zig",), "//", None, ('"',), (r'@import\(\s*"([^"]+)"',), (r"(?i)[/\\]tests?[/\\]",)),
    Language("Nix", (".nix",), "#", C_BLOCK, ('"',), data=True),
    Language("Haskell", (".hs", ".lhs"), "--", ("{-", "-}"), ('"',), (r"\bimport\s+(?:qualified\s+)?([\w.]+)",), (_SPECS,)),
    Language("OCaml", (".ml", ".mli"), None, ("(*", "*)"), ('"',)),
    Language("SQL", (".sql",), "--", C_BLOCK, ("'", '"'), data=True),
    Language("HTML", (".html", ".htm", ".vue.html"), None, XML_BLOCK, ('"', "'"), data=True),
    Language("CSS", (".css", ".scss", ".sass", ".less", ".styl"), None, C_BLOCK, ('"', "'"), data=True),
    Language("Markdown", (".md", ".markdown", ".mdx"), "<!--", data=True),
    Language("YAML", (".yml", ".yaml"), "#", None, ('"', "'"), data=True),
    Language("JSON", (".json", ".jsonc", ".json5"), None, None, ('"',), data=True),
    Language("TOML", (".toml",), "#", None, ('"', "'"), data=True),
    Language("Make", (".mk",), "#", None, ('"', "'"), data=True),
    Language("Docker", (".dockerfile",), "#", None, ('"', "'"), data=True),
    # named by file name only
    Language("CMake", (), "#", data=True),
    Language("Npm", (), "#", None, ('"', "'"), data=True),
    Language("GoModule", (), "//", None, ('"', "`"), data=True),
    Language("Cargo", (), "#", None, ('"',), data=True),
    Language("PipRequirements", (), "#", data=True),
    Language("Pipfile", (), "#", data=True),
    Language("GemfileLock", (), "#", data=True),
)

# Lower-case file names that set the language.
FILE_NAMES = {
    "dockerfile": "Docker", "makefile": "Make", "gnumakefile": "Make", "rakefile": "Ruby", "gemfile": "Ruby",
    "brewfile": "Ruby", "vagrantfile": "Ruby", "cmakelists": "CMake", "cmakelists.txt": "CMake", "go.mod": "GoModule",
    "cargo.toml": "Cargo", "package.json": "Npm", "requirements.txt": "PipRequirements", "pipfile": "Pipfile",
    "gemfile.lock": "GemfileLock",
}

# Extensions of binary files.
BINARY_EXTS = (
    ".png .jpg .jpeg .gif .bmp .ico .webp .tiff .avif .svgz .mp3 .mp4 .wav .ogg .flac .avi .mov .mkv .webm .aac "
    ".zip .gz .bz2 .xz .7z .rar .tar .tgz .zst .jar .war .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods "
    ".so .dylib .dll .exe .bin .o .a .class .pyc .pyo .wasm .woff .woff2 .ttf .eot .otf .db .sqlite .sqlite3 .mdb "
    ".psd .ai .sketch .blend .glb .gltf .obj .fbx .pack .idx"
).split()

# Directories of vendored and segments of generated files.
VENDOR_SEGMENTS = (
    "node_modules vendor third_party thirdparty bower_components .venv venv env site-packages dist build out target "
    "coverage .next .nuxt .svelte-kit .output .cache .parcel-cache __pycache__ .mypy_cache .pytest_cache .tox .gradle "
    "Pods DerivedData .terraform .idea .vscode-test"
).split()
GENERATED_SEGMENTS = (
    "generated gen __generated__ autogen migrations proto node_modules dist build vendor .pb schema fixtures snapshots __snapshots__"
).split()

# Debt markers by label, with weights, and suppression directives.
DEBT = {"FIXME": 3, "TODO": 2, "WORKAROUND": 2, "DEPRECATED": 3, "REFACTOR": 2, "OPTIMIZE": 1, "REVIEW": 1, "SECURITY": 2, "SUPPRESSED": 2}
SUPPRESSION = (
    r"(?i)(?<![\w$.])(?:eslint-disable(?:-[a-z-]+)?|@ts-(?:ignore|expect-error|nocheck)|istanlab?[ \t]ignore[ a-z]*|nolint\b|noqa\b"
    r"|#\s*type:\s*ignore|#\s*noqa|coverage:\s*ignore|@jsxIgnore|pragma:\s*no cover)"
)

# Keyword families.
FAMILIES = {
    "curly": "JavaScript TypeScript Java Kotlin C# C C++ Swift Dart PHP Vue Svelte Zig".split(),
    "python": ["Python"],
    "go": ["Go"],
    "rust": ["Rust"],
    "functional": "Haskell OCaml Elixir Scala Erlang".split(),
}
KEYWORDS = {
    "curly": ["if", "for", "while", "switch", "case", "catch", "else if", "do", "foreach", "unless", "when"],
    "python": ["if", "elif", "for", "while", "except", "case", "and", "or"],
    "go": ["if", "for", "case", "select", "switch", "range", "go", "defer"],
    "rust": ["if", "for", "while", "loop", "match", "if let", "while let"],
    "functional": ["if", "case", "when", "guard", "cond", "match"],
    "generic": ["if", "else", "for", "while", "case", "catch", "except", "elif", "when", "unless", "foreach", "switch", "select", "rescue"],
}
DEFINITIONS = {
    "curly": [
        r"\bfunction\s*[\w$]*\s*\(",
        r"=>\s*\{",
        r"\bclass\s+[\w$]+",
        r"(?m)^[ \t]*(?:public|private|protected|static|async|override|export|get|set)\s+[\w$]+\s*\(",
        r"\bfunc\s+\w+",
    ],
    "python": [r"(?m)^\s*def\s+\w+", r"(?m)^\s*class\s+\w+", r"(?m)^\s*async\s+def\s+\w+"],
    "go": [r"(?m)^\s*func\s+"],
    "rust": [r"\bfn\s+\w+", r"\bimpl\b", r"\btrait\s+\w+", r"\bstruct\s+\w+", r"\benum\s+\w+"],
    "generic": [
        r"\bfunction\s*\w*\s*\(", r"\bdef\s+\w+", r"\bfunc\s+\w+", r"\bclass\s+\w+", r"\btype\s+\w+\s+struct", r"\binterface\s+\w+", r"\btrait\s+\w+",
    ],
}
DECISION_CAP, DEFINITION_CAP, IMPORT_CAP, DEBT_CAP, OPERATOR_SHARE_CAP = 5000, 2000, 2000, 200, 40
MAX_BYTES, SNIFF_BYTES = 1_500_000, 8192

# Extensions and index files that an import may leave out, in order of preference.
PROBE_EXTS = ".ts .tsx .mts .cts .js .jsx .mjs .cjs .py .go .rs .rb .java .kt .cs .php .vue .svelte .dart".split()
INDEX_NAMES = "index.ts index.tsx index.js index.jsx index.mjs index.py index.vue index.go index.rs index.dart".split()

# Root files that declare dependencies.
MANIFESTS = {
    "package.json": "npm", "requirements.txt": "pip", "pyproject.toml": "pypi", "Pipfile": "pipenv", "go.mod": "go", "Cargo.toml": "cargo",
    "Gemfile": "bundler", "composer.json": "composer", "pubspec.yaml": "pub", "build.gradle": "gradle", "pom.xml": "maven",
}

# Modules that need no declaration, by ecosystem, and names of local directories.
STDLIB = {
    "python": (
        "os sys re json time datetime math random itertools functools collections typing pathlib subprocess threading logging io abc enum "
        "dataclasses asyncio unittest hashlib base64 urllib http socket ssl shutil tempfile uuid copy pickle csv jsonlines textwrap warnings "
        "contextlib inspect operator string traceback types ast glob signal stat struct binascii gzip zlib platform getpass secrets statistics"
    ).split(),
    "node": (
        "fs path os http https url util events stream child_process crypto zlib buffer assert net tls dns readline worker_threads "
        "cluster querystring string_decoder timers v8 vm perf_hooks async_hooks punycode tty process module constants assert/strict fs/promises "
        "node:test inspector repl stream/consumers stream/promises stream/web util/types timers/promises sqlite sea test diagnostics_channel"
    ).split(),
    "go": (
        "bufio bytes context crypto database embed encoding errors fmt hash html image index io log math mime net os path reflect regexp "
        "runtime sort strconv strings sync syscall testing text time unicode unsafe slices maps cmp iter unique weak structs arena log/slog"
    ).split(),
    "rust": (
        "std core alloc crate self super test serde tokio anyhow thiserror clap log regex lazy_static once_cell itertools rand chrono uuid futures"
    ).split(),
    "jvm": "java javax jakarta kotlin scala android sun com org io net".split(),
}
STDLIB_OF_KIND = {"pip": "python", "pipenv": "python", "pypi": "python", "npm": "node", "go": "go", "cargo": "rust", "gradle": "jvm", "maven": "jvm"}
LOCAL_NAMES = (
    "utils util helpers helper lib libs common shared core types models model services service components component hooks api app "
    "main index config constants consts internal pkg domain src client server test tests spec scripts tools vendor assets"
).split()

# Weights of the risk score, in order.
RISK_WEIGHTS = {"churn": 0.20, "complexity": 0.22, "size": 0.10, "debt": 0.12, "ownership": 0.10, "blastRadius": 0.10, "untested": 0.10, "suppression": 0.06}
GRADES = ((85, "A"), (72, "B"), (58, "C"), (42, "D"))

BY_NAME = {x.name: x for x in LANGUAGES}
BY_EXT = {e: x.name for x in reversed(LANGUAGES) for e in reversed(x.exts)}


def family(language: str) -> str:
    return next((f for f, names in FAMILIES.items() if language in names), "generic")


def definition_patterns(language: str) -> list[str]:
    return DEFINITIONS.get(family(language), DEFINITIONS["generic"])


def keyword_pattern(word: str) -> str:
    """The word where no word character, $ or dot stands before it and no word character or $ behind."""
    return rf"(?<![\w$.]){word.replace(' ', chr(92) + 's+')}(?![\w$])"
