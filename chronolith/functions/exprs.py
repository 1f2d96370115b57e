"""Scalar column functions: paths, names, dates, scores.  All are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import BINARY_EXTS, BY_EXT, BY_NAME, FILE_NAMES, GENERATED_SEGMENTS, GRADES, VENDOR_SEGMENTS


def _strings(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the base name on; none if that is missing or first."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def top_dirs(path: Column, depth: int = 2) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, F.lit("(root)")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/"))


def join_path(importer: Column, relative: Column) -> Column:
    """relative seen from importer's directory, without empty and `.` segments; `..` takes one back and stops at the root."""
    whole = F.concat(F.regexp_extract(importer, r"(?s)^(.*/)[^/]*$", 1), relative)
    parts = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    return F.array_join(folded, "/")


def relative_import(importer: Column, spec: Column) -> Column:
    """join_path for specs that begin with a dot, null above the root and for other specs."""
    parts = F.filter(F.split(F.concat(F.regexp_extract(importer, r"(?s)^(.*/)[^/]*$", 1), spec), "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("below"))

    def step(acc: Column, s: Column) -> Column:
        up = s == ".."
        return F.struct(F.when(up, F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["p"], s)).alias("p"), (acc["below"] | (up & (F.size(acc["p"]) == 0))).alias("below"))

    done = F.aggregate(parts, start, step)
    return F.when(F.startswith(spec, F.lit(".")) & ~done["below"], F.array_join(done["p"], "/"))


def external_name(spec: Column) -> Column:
    """The package of an import: `@scope/name`, or what stands before `/` or `:`; null for odd bare words."""
    clean = F.regexp_replace(F.regexp_replace(spec, r"^package:", ""), r"^node:", "")
    head = F.regexp_extract(clean, r"(?s)^([^/:]*)", 1)
    scoped = F.array_join(F.slice(F.split(clean, "/"), 1, 2), "/")
    odd = ~clean.rlike(r"[@/.:]") & ~clean.rlike(r"(?i)^[a-z][a-z0-9_-]*$")
    return F.when(F.startswith(clean, F.lit("@")), scoped).when((head == "") | odd, F.lit(None)).otherwise(head)


def clean_spec(spec: Column) -> Column:
    """An import without the prefixes of bundlers; null for `dart:` and empty ones; `#`, `~` and `@/` become `./`."""
    s = F.regexp_replace(spec, r"^package:", "")
    dart = F.startswith(s, F.lit("dart:"))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^node:", ""), r"^bun:", ""), r"^file://", "")
    alias = s.rlike(r"^(#|~|@/)")
    return F.when((spec == "") | dart, F.lit(None)).when(alias, F.concat(F.lit("./"), F.regexp_replace(s, r"^[#~@]+/?", ""))).otherwise(s)


def author_key(name: Column, email: Column) -> Column:
    mail, who = F.lower(F.trim(F.coalesce(email, F.lit("")))), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(mail != "", mail).when(who != "", F.concat(F.lit("name:"), who)).otherwise(F.lit("unknown"))


def sanitize_subject(subject: Column) -> Column:
    return F.when(subject.rlike(r"[\x01\x02]"), F.regexp_replace(subject, r"[\x00-\x1f]", " ")).otherwise(subject)


def normalize_py(name: Column) -> Column:
    return F.translate(F.lower(name), "_", "-")


def test_stem(path: Column, keep_extension: bool = False) -> Column:
    """The file that a test file's name points to.  Suffix forms lose their extension, so they name no file; keep_extension mends that."""
    if keep_extension:
        s = F.regexp_replace(path, r"(?i)\.(test|spec)(\.[cm]?[jt]sx?)$", "$2")
    else:
        s = F.regexp_replace(path, r"(?i)\.(test|spec)\.[cm]?[jt]sx?$", "")
    s = F.regexp_replace(s, r"(?i)^(.*?)[/\\](tests?|__tests__)[/\\]", "$1/")
    s = F.regexp_replace(s, r"(?i)^(.*?)/(test|tests)_", "$1/")
    s = F.regexp_replace(s, r"(?i)_test(\.[a-z]+)$", "$1" if keep_extension else "")
    return F.regexp_replace(s, r"(?i)/test\.[a-z]+$", "")


def language_for(path: Column) -> Column:
    """By file name first, then by `.d.ts`, then by the last extension; null if none is known."""
    base = F.lower(basename(path))
    names = F.create_map(*(F.lit(x) for kv in FILE_NAMES.items() for x in kv))
    exts = F.create_map(*(F.lit(x) for kv in BY_EXT.items() for x in kv))
    return F.coalesce(F.try_element_at(names, base), F.when(F.endswith(base, F.lit(".d.ts")), F.lit("TypeScript")), F.try_element_at(exts, F.regexp_extract(base, r"(?s)(\.[^.]*)$", 1)))


def is_data(language: Column) -> Column:
    return language.isin([x.name for x in BY_NAME.values() if x.data])


def is_excluded(path: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        if n:
            out = out | F.contains(path, F.lit(n))
    return out


def is_vendor(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.contains(path, F.lit("node_modules/")) | F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), _strings(VENDOR_SEGMENTS))


def is_generated(path: Column) -> Column:
    """By a segment, or by the name of a file that tools write."""
    # fixed value: suffixes of generated files
    tail = path.rlike(r"(?i)\.pb\.[a-z]+$|\.g\.[a-z]+$|\.gen\.[a-z]+$|\.generated\.[a-z]+$|\.min\.[a-z]+$|_pb2?\.pyi?$|_pb\.[a-z]+$")
    return F.arrays_overlap(F.split(path, "/"), _strings(GENERATED_SEGMENTS)) | tail


def is_binary_name(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(?s)(\.[^./]*)$", 1).isin(BINARY_EXTS)


def is_test(path: Column, language: Column) -> Column:
    out = F.when(language.isNull(), F.lit(False))
    for x in BY_NAME.values():
        if x.tests:
            hit = F.lit(False)
            for p in x.tests:
                hit = hit | path.rlike(p)
            out = out.when(language == x.name, hit)
    return out.otherwise(F.lit(False))


def day_index(date: Column) -> Column:
    """Days since the epoch, 0 where the date is unknown."""
    return F.coalesce(F.unix_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date")), F.lit(0))


def month_of(date: Column) -> Column:
    return F.when(F.length(date) >= 7, F.substring(date, 1, 7)).otherwise(F.lit("unknown"))


def _ladder(value: Column, steps: Iterable[tuple[float, str]], last: str) -> Column:
    steps = list(steps)
    out = F.when(value <= steps[0][0], F.lit(steps[0][1]))
    for most, label in steps[1:]:
        out = out.when(value <= most, F.lit(label))
    return out.otherwise(F.lit(last))


def recency_bucket(days: Column) -> Column:
    return _ladder(days, ((7, "this week"), (30, "this month"), (90, "3 months"), (365, "a year"), (730, "2 years")), "3+ years")


def activity(days: Column) -> Column:
    return _ladder(days, ((30, "active"), (180, "recent"), (365, "lurking")), "dormant")


def normalize(value: Column, most: Column) -> Column:
    """Logarithmic share of the maximum, 0..1."""
    return F.when((F.coalesce(most, F.lit(0)) <= 0) | (value <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.log1p(value) / F.log1p(most)))


def grade(value: Column) -> Column:
    out = F.when(value >= GRADES[0][0], F.lit(GRADES[0][1]))
    for least, letter in GRADES[1:]:
        out = out.when(value >= least, F.lit(letter))
    return out.otherwise(F.lit("E"))


def js_round(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
