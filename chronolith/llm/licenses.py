"""License scans: normalised text against licence templates by Dice coefficient over word bigrams; built-in functions only."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Wording of public licences and notices, by SPDX identifier and form.
TEMPLATES = {
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        "this permission notice appear in all copies."
    ),
    "Apache-2.0 header start": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    # whole texts and headers, by file name
    **{f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},
}


def normal_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    flat = F.translate(text, A_Z, a_z)
    return F.filter(F.split(flat, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word stands for itself."""
    n = F.size(words)
    pairs = F.arrays_zip(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    return F.array_distinct(F.when(n == 1, words).otherwise(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))))


def _template_words(text: str) -> list[str]:
    flat = text.translate(str.maketrans(A_Z, a_z))
    return [w for w in "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in flat).split(" ") if w]


def _template_bigrams(text: str) -> list[str]:
    words = _template_words(text)
    return list(dict.fromkeys([f"{a} {b}" for a, b in zip(words, words[1:])] or words))


def _least_shared(n: int, least: float) -> int:
    """Bigrams that a segment of a fitting size must share with a template of n."""
    smallest = math.ceil(n * least / (2 - least) - 1e-9)
    return math.ceil(least / 2 * (smallest + n) - 1e-9)


def gate_words(sets: list[list[str]], least: float) -> list[str] | None:
    """Words of which every match holds at least one, or None if there are none such.

    A match misses at most n - _least_shared(n) bigrams of its template, so words that
    stand in more bigrams than that cannot all be absent.  Long words go first.
    """
    chosen: dict[str, None] = {}
    for b in sorted(sets, key=len):
        spare = len(b) - _least_shared(len(b), least)
        if spare >= len(b):
            return None
        of: dict[str, set[int]] = {}
        for i, pair in enumerate(b):
            for w in pair.split(" "):
                of.setdefault(w, set()).add(i)
        touched = {i for w in chosen for i in of.get(w, ())}
        while len(touched) <= spare:
            w = max(of, key=lambda w: (bool(of[w] - touched), len(w) >= 6, len(of[w] - touched), len(w), w))
            chosen[w] = None
            touched |= of[w]
    return list(chosen)


def gate_pattern(words: list[str]) -> str:
    """A pattern that finds any of the normal words in a text as it stands: one pass, branching by letter."""

    def branch(rest: list[str]) -> str:
        ends = "" in rest
        by: dict[str, list[str]] = {}
        for w in sorted(rest):
            if w:
                by.setdefault(w[0], []).append(w[1:])
        if not by:
            return ""
        inner = "|".join(re.escape(c) + branch(tails) for c, tails in by.items())
        return f"(?:{inner}){'?' if ends else ''}" if ends or len(by) > 1 else inner

    # without (?u) only A-Z and a-z are the same; what parts words is not a letter, digit or beyond ASCII
    return f"(?i)(?<![a-z0-9\\x80-\\x{{10FFFF}}]){branch(words)}(?![a-z0-9\\x80-\\x{{10FFFF}}])"


def _literal(values: list[str]) -> Column:
    """An array as one literal of the plan; words and bigrams hold no line feed."""
    return F.split(F.lit("\n".join(values)), "\n", -1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_PASSAGE = "array<struct<minus:double,i:int,a:int,b:int,dice:double>>"


def _passages(g: Column, t: Column, least: float) -> Column:
    """(rank, i, first, last, dice) of runs of the bigrams g in order that match template t of _table(), one a beginning at most."""
    need, n, length, most = t["need"], t["n"], t["length"], t["most"]

    def of_hits(h: Column) -> Column:
        def apart(k: Column, step: int, edge: Column) -> Column:
            """Hits that more hits next to them would not better, and those that may be the edge of a copy."""
            return ~F.coalesce(F.get(h, k + step) == F.get(h, k) + step, F.lit(False)) | (F.get(g, F.get(h, k)) == edge)

        every = F.sequence(F.lit(0), F.size(h) - 1)

        def best_ends(ends: Column) -> Column:
            def best_end(k: Column) -> Column:
                first = F.get(h, k)
                fit = F.filter(ends, lambda j: (j >= k + (need - 1)) & (F.get(h, j) - first < most))
                scored = F.transform(fit, lambda j: F.struct((F.least(j - k + 1, length) / (F.get(h, j) - first + 1 + length)).alias("s"), (-F.get(h, j)).alias("e")))
                return F.struct(first.alias("a"), (-F.array_max(scored)["e"]).alias("b"))

            # a beginning has room if enough hits follow within the longest run
            starts = F.filter(every, lambda k: (k <= F.size(h) - need) & (F.get(h, k + (need - 1)) - F.get(h, k) < most) & apart(k, -1, t["first"]))
            return F.filter(F.transform(starts, best_end), lambda c: c["b"].isNotNull())

        def dice(c: Column) -> Column:
            exact = _let(F.array_distinct(F.slice(g, c["a"] + 1, c["b"] - c["a"] + 1)), lambda s: 2.0 * F.size(F.array_intersect(s, t["b"])) / (F.size(s) + n))
            return F.struct(exact.alias("dice"), t["i"].alias("i"), c["a"].alias("a"), c["b"].alias("b"))

        return F.transform(
            F.filter(F.transform(_let(F.filter(every, lambda k: apart(k, 1, t["last"])), best_ends), dice), lambda c: c["dice"] >= least),
            lambda c: F.struct((-F.pow(c["dice"], 3) * n).alias("minus"), c["i"], c["a"], c["b"], c["dice"]),
        )

    places = F.filter(F.transform(g, lambda w, p: F.when(F.array_contains(t["b"], w), p)), lambda p: p.isNotNull())
    return _let(places, lambda h: F.when(F.size(h) >= need, of_hits(h).cast(_PASSAGE)).otherwise(F.array().cast(_PASSAGE)))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_segments, matches (segment, license, dice) of every row; segment 0 is the whole text, others count its lines from 1, and -i is a passage that begins in line i.

    Segments are the whole text and, if it has more than one, each line.  A segment
    matches its template of the highest Dice coefficient of word-bigram sets if that
    is `least` or more; of equal ones the first by name.  A coefficient of `least` asks
    that the sizes of both sets lie within least / (2 - least) of each other, so only
    templates of such sizes are compared, and bigrams of segments with too few words
    for the smallest template are never made.

    Passages are runs of words inside a text, over line ends too.  For each template of
    two words and more they begin at a bigram of the template and end at the one that
    shares the most for its length, up to the length that `least` allows; of those with
    a coefficient of `least` or more the best by its cube times the template's size are
    taken first, so a whole licence goes before its parts, and none overlaps another.
    Passages inside a line that matches, and of the template that the whole text
    matches, are left out as they are known.  Segments are counted without passages.

    Texts without any of gate_words() have no match and are not split into words.
    All work is done row by row without a shuffle, so no group of copies is a hot
    task.  Templates are a parameter held in the plan.  A null text has no segments,
    an empty one none that match; equal rows are kept and other columns left alone.
    """
    known = [(name, _template_bigrams(t)) for name, t in sorted(templates.items())]
    known = [(name, b) for name, b in known if b]
    ratio = least / (2 - least)
    # whole numbers of bigrams, so that rounding drops no template at the bounds
    span = {len(b): (math.ceil(len(b) * ratio - 1e-9), math.floor(len(b) / ratio + 1e-9)) for _, b in known}
    fewest = min((lo for lo, _ in span.values()), default=1)
    lines = F.split(F.col(text), "\n", -1)
    segments = F.when(F.col(text).isNull(), F.array().cast("array<string>")).when(F.size(lines) > 1, F.concat(F.array(F.col(text)), lines)).otherwise(F.array(F.col(text)))
    feeds = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n_segments = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.when(feeds > 0, feeds + 2).otherwise(F.lit(1))).cast("long")
    cast = "array<struct<segment:int,license:string,dice:double>>"
    if not known:
        return docs.select(F.col(key).alias(key), n_segments.alias("n_segments"), F.array().cast(cast).alias("matches"))

    def compare(seg: Column, table: Column) -> Column:
        """The best (dice, license) of a segment's (place, bigrams)."""
        n = F.size(seg["b"])

        def one(t: Column) -> Column:
            dice = F.when(n.between(t["low"], t["high"]), 2.0 * F.size(F.array_intersect(seg["b"], t["b"])) / (n + t["n"]))
            return F.struct(dice.alias("dice"), (-t["i"]).alias("i"), t["name"].alias("license"))

        top = F.array_max(F.filter(F.transform(table, one), lambda x: x["dice"] >= least))
        return F.struct(seg["i"].alias("segment"), top["license"].alias("license"), top["dice"].alias("dice"))

    # a text of few characters has too few words; this spares most lines the split into words
    long_enough = F.transform(segments, lambda s, i: F.struct(i.alias("i"), F.when(F.length(s) >= 2 * fewest - 1, normal_words(s)).alias("w")))
    with_words = F.filter(long_enough, lambda x: F.size(x["w"]) >= max(1, fewest))
    sets = F.transform(with_words, lambda x: F.struct(x["i"].alias("i"), bigrams(x["w"]).alias("b")))
    numbered = F.flatten(F.transform(lines, lambda s, i: F.transform(normal_words(s), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))

    def in_passages(x: Column, hits: Column, table: Column) -> Column:
        """hits and the passages of words x (w, line)."""
        near = F.arrays_zip(F.slice(x["w"], F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))).alias("a"), F.slice(x["w"], F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))).alias("b"))
        ordered = F.transform(near, lambda p: F.concat_ws(" ", p["a"], p["b"]))

        def of_all(g: Column, distinct: Column) -> Column:
            def of_one(t: Column) -> Column:
                at = (t["length"] > 0) & (F.size(F.array_intersect(distinct, t["b"])) >= t["need"]) & ~F.exists(hits, lambda m: (m["segment"] == 0) & (m["license"] == t["name"]))
                return F.when(at, _passages(g, t, least)).otherwise(F.array().cast(_PASSAGE))

            return F.flatten(F.transform(table, of_one))

        apart = F.aggregate(
            F.array_sort(_let(ordered, lambda g: _let(F.array_distinct(g), lambda d: of_all(g, d)))),
            F.array().cast(_PASSAGE),
            lambda taken, c: F.when(F.exists(taken, lambda t: (t["a"] <= c["b"] + 1) & (c["a"] <= t["b"] + 1)), taken).otherwise(F.concat(taken, F.array(c))),
        )
        names = F.array(*(F.lit(name) for name, _ in known))
        shown = F.transform(F.array_sort(F.transform(apart, lambda c: F.struct(c["a"], c["b"], c["i"], c["dice"]))), lambda c: F.struct(
            F.get(x, c["a"])["line"].alias("first"), F.get(x, c["b"] + 1)["line"].alias("last"), F.get(names, c["i"]).alias("license"), c["dice"],
        ))
        new = F.filter(shown, lambda c: ~((c["first"] == c["last"]) & F.exists(hits, lambda m: (m["segment"] == c["first"]) | ((m["segment"] == 0) & (F.size(segments) == 1)))))
        return F.concat(hits, F.transform(new, lambda c: F.struct((-c["first"]).alias("segment"), c["license"], c["dice"])).cast(cast))

    def whole_job(table: Column) -> Column:
        found = F.filter(F.transform(sets, lambda x: compare(x, table)), lambda m: m["dice"].isNotNull()).cast(cast)
        return _let(found, lambda hits: _let(numbered, lambda x: in_passages(x, hits, table)))

    def row(i: int, name: str, b: list[str]) -> Column:
        words = _template_words(templates[name])
        run = len(words) - 1
        ints = {"i": i, "n": len(b), "low": span[len(b)][0], "high": span[len(b)][1], "need": max(1, _least_shared(len(b), least)), "length": run, "most": math.floor(run / ratio + 1e-9)}
        texts = {"name": name, "first": b[0], "last": " ".join(words[-2:])}
        return F.struct(_literal(b).alias("b"), *(F.lit(v).alias(k) for k, v in {**ints, **texts}.items()))

    # one literal, however many templates: the plan does not grow with them
    all_found = _let(F.array(*(row(i, name, b) for i, (name, b) in enumerate(known))), whole_job)
    gate = gate_words([b for _, b in known], least)
    if gate is not None:
        all_found = F.when(F.rlike(F.col(text), F.lit(gate_pattern(gate))), all_found).otherwise(F.array().cast(cast))
    all_found = F.when(F.col(text).isNull(), F.array().cast(cast)).otherwise(all_found)
    return docs.select(F.col(key).alias(key), n_segments.alias("n_segments"), all_found.alias("matches"))
