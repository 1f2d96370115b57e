"""The ten operators against brute force on small fixtures with nulls, ties, repeats, long texts and empty tables."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import chat, decontam, frames, mixing, ngrams, quality, sharding, tokens, urls
from chronolith.llm import queries as Q
from chronolith.llm import text as TX

SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(s: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def docs_of(spark, rows, ddl="doc_id long, text string, source string, k string, part long, size string"):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y")[:6] for r in rows], ddl)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, nulls, empties, a very long one and a hot source."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5))) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One TWO"), (5, "w " * 30_000)]
    base = [r.choice(words) for _ in range(120)]
    for i in range(6, 90):  # near copies of one text, with few to many edits
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base)) for i in range(90, 140)]
    rows += [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 80)))) for i in range(140, 220)]
    rows += [(300, rows[200][1]), (None, "lost key"), (200, rows[200][1])]
    return [(i, t, None if (i or 0) % 11 == 10 else ("hot" if (i or 0) % 3 else f"s{(i or 0) % 7}")) for i, t in rows]


# ---- kernels


@pytest.mark.parametrize(("word_bytes", "pattern"), [(TX.NON_SPACE, SPACE_WORD), (TX.ALNUM, ALNUM_WORD)])
@pytest.mark.parametrize("size", [40, 1 << 20])
def test_words_and_hashes(word_bytes, pattern, size):
    r = random.Random(1)
    texts = [None, "", "x" * 100] + ["".join(r.choice("aB 9-é\n.\x00") for _ in range(r.randint(0, 60))) for _ in range(300)]
    seen: dict[str, int] = {}
    for run in TX.runs(pa.array(texts), size):
        w = TX.words(run, word_bytes)
        h = TX.word_hashes(run, w, fold=True)
        for i in range(run.last - run.first):
            a, b = w.index[i : i + 2]
            want = re.findall(pattern, lower(texts[run.first + i]))
            assert [lower(bytes(run.data[s:e]).decode()) for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] == want
            for x, y in zip(want, h[a:b], strict=True):
                assert seen.setdefault(x, int(y)) == int(y)
    assert len(set(seen.values())) == len(seen)


# ---- 1 sharding


def test_sharding(spark, corpus):
    out = sharding.shard(docs_of(spark, corpus), 4, keep=("text", "k", "size")).toPandas()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    assert sorted(zip(out.doc_id.fillna(-1).astype(int), out["size"], out.text_crc32, strict=True)) == want
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    total, largest = out["size"].sum(), out["size"].max()
    assert (out.groupby("shard")["size"].sum() - total / 4).abs().max() <= largest + total / 4 * sharding.WHOLE_GROUP
    assert list(out.columns) == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "k"]


def brute_shards(rows, shards):
    """Shards and slots by sorting all rows, adding sizes up one by one and cutting where the sum passes each target."""
    line, group, shard_of = [], [], []
    for g, _, i, t in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)):
        line.append((i, len(t.encode()) + 1))
        group.append((g, t))
    before = [0]
    for _, n in line:
        before.append(before[-1] + n)
    total, cuts = before[-1], []
    for s in range(1, shards):
        aim = total * s // shards
        for lo in range(len(line)):
            hi = next(j for j in range(lo, len(line) + 1) if j == len(line) or group[j] != group[lo])
            first = next(j for j in range(lo + 1) if group[j] == group[lo])
            if before[first] < aim < before[hi]:
                if before[hi] - before[first] <= total / shards * sharding.WHOLE_GROUP:
                    aim = before[first] if aim - before[first] <= before[hi] - aim else before[hi]
                break
        cuts.append(aim)
    slots = Counter()
    for (i, _), b in zip(line, before):
        s = sum(b >= c for c in cuts)
        shard_of.append((i, s, slots[s]))
        slots[s] += 1
    return shard_of


def test_sharding_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["é" * r.randint(0, 30), f"text {r.randint(0, 25)} " + "x" * r.randint(0, 3)]), None) for i in range(260)] + [(900 + i, "hot", None) for i in range(90)] + [(None, "hot", None)]
    d = docs_of(spark, rows)
    keyed = d.select(F.xxhash64("text").alias("g"), F.crc32("text").alias("c"), "doc_id", "text").collect()
    want = brute_shards([tuple(x) for x in keyed], 5)
    got = sharding.shard(d, 5).select("doc_id", "shard", "slot").collect()
    plain = lambda x: sorted(((i is None, i or 0, s, n) for i, s, n in x))
    assert plain(tuple(x) for x in got) == plain(want)
    assert sharding.shard(d.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="slot"):
        sharding.shard(d.withColumnRenamed("doc_id", "slot"), 5, key="slot")


def test_sharding_balances_and_keeps_groups(spark):
    rows = [(i, f"text {i % 900} " + "x" * (i % 50), None) for i in range(3000)] + [(5000 + i, "hot copy", None) for i in range(1500)]
    out = sharding.shard(docs_of(spark, rows), 8).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.05 * sums.mean()
    split = out.groupby("text_crc32").shard.nunique()
    assert (split > 1).sum() <= 1  # only the group that exceeds a shard
    again = sharding.shard(docs_of(spark, rows), 8).toPandas()
    key = ["doc_id", "slot"]
    pd.testing.assert_frame_equal(out.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


# ---- 2 n-gram join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(SPACE_WORD, lower(t))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    up = {i: i for i in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, x in sets.items() if i is not None for s in x if s]
    for n, (a, s) in enumerate(flat):
        for b, t in flat[:n]:
            both = len(s & t)
            if 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in up}, sets


@pytest.mark.parametrize(("short", "block"), [(64, 400), (4, 400), (4, 16)])
def test_ngram_join_equals_all_pairs(spark, corpus, short, block):
    rows = [(i, t) for i, t, _ in corpus]
    rows += [(400, rows[150][1]), (400, rows[160][1]), (401, rows[170][1]), (400, rows[180][1])]  # one key, several texts
    want, sets = brute_components(rows)
    assert want[400] == want[150] == want[160] == want[180] == 150
    out = ngrams.near_duplicates(docs_of(spark, [(*r, None) for r in rows]), short=short, block_docs=block).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == want.get(r.doc_id)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert len(set(want.values())) < len(want) - 50


def test_stars_of_several_components(spark):
    """Texts that share one frequent passage in every prefix, in groups that link only inside, by chains that their centres do not reach."""
    r = random.Random(4)
    passage = [f"p{i}" for i in range(14)]
    rows = []
    for g in range(6):
        w = [*passage, *(f"g{g}x{i}" for i in range(60))]
        for _ in range(25):
            w = list(w)
            w[r.randrange(14, len(w))] = f"n{len(rows)}"
            rows.append((len(rows) * 7 % 151, " ".join(w), None))
    want, _ = brute_components([(i, t) for i, t, _ in rows])
    assert 6 <= len(set(want.values())) < 100
    out = ngrams.near_duplicates(docs_of(spark, rows), short=3, block_docs=10).collect()
    assert {x.doc_id: x.component_id for x in out} == want


def test_shingle_order_where_leading_bits_tie():
    g = np.array([5, 3, 4, 3, 1 << 63, 2], np.uint64)
    owner = np.array([1, 1, 0, 1, 1, 1])
    by = ngrams._sorted(2, owner, None, g)
    assert g[by].tolist() == [4, 2, 3, 3, 5, 1 << 63] and owner[by].tolist() == [0, 1, 1, 1, 1, 1]
    by = ngrams._sorted(2, owner, np.array([0, 2, 0, 2, 1, 1]), g)
    assert g[by].tolist() == [4, 5, 2, 1 << 63, 3, 3]


def test_ngram_join_of_odd_tables(spark):
    none = ngrams.near_duplicates(spark.createDataFrame([], "doc_id int, text string"))
    assert none.collect() == [] and none.dtypes == [("doc_id", "int"), ("n_shingles", "bigint"), ("component_id", "int")]
    with pytest.raises(ValueError, match="whole"):
        ngrams.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError, match="n_shingles"):
        ngrams.near_duplicates(spark.createDataFrame([(1, "b")], "n_shingles int, text string"), key="n_shingles")


def test_keep_one(spark, corpus):
    want, _ = brute_components([(i, t) for i, t, _ in corpus])
    d = docs_of(spark, corpus)
    kept = ngrams.keep_one(d)
    assert kept.columns == d.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _ in corpus if want.get(i) == i)


@pytest.mark.parametrize("last", [0, 50, frames.LAST_LINKS])
def test_components_of_chains_and_hubs(spark, last):
    e = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (None, 3), (60, 59)]
    got = {r.node: r.component for r in frames.components(spark.createDataFrame(e, "a long, b long"), "a", "b", last).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 400)}}
    assert frames.components(spark.createDataFrame([], "a long, b long"), "a", "b", last).count() == 0


@pytest.mark.parametrize("form", ["up", "down", "shuffled"])
def test_rounds_grow_with_the_logarithm(spark, form):
    n = 10_000
    ids = list(range(n))[:: -1 if form == "down" else 1]
    if form == "shuffled":
        random.Random(1).shuffle(ids)
    report: list[int] = []
    got = frames.components(spark.createDataFrame(pa.table({"a": ids[:-1], "b": ids[1:]})), "a", "b", 0, report).collect()
    assert len(got) == n and {r.component for r in got} == {0} and len(report) <= 20


def test_lowest_labels():
    r = random.Random(2)
    for n in (1, 2, 30, 400):
        e = [(r.randrange(n), r.randrange(n)) for _ in range(n)]
        up = list(range(n))
        for _ in range(n):
            for u, v in e:
                up[u] = up[v] = min(up[u], up[v])
        assert frames.lowest_labels(n, *np.array(e).T).tolist() == up


# ---- 4 decontamination


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(spark, block_bytes):
    r = random.Random(5)
    vocabulary = "aa bb cc dd ee ff gg É1 hh".split()
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([12, 15, 3, 1, 2, 30, 11, 0, 10, 10])] + [(3, "zz yy"), (50, None), (None, "aa bb")]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for i in range(80)]
    rows += [(1000 + i, "x, " * r.randint(0, 5) + items[r.choice([0, 1, 5, 6, 8])][1].upper().replace(" ", r.choice([" ", ", ", "\n"])) + " tail") for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "!!! "), (7, "dup aa"), (7, "dup aa"), (2003, "qq " * 20_000)]
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = re.findall(ALNUM_WORD, lower(t))
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k and i is not None else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))

    def brute(t):
        w, hit, ids = re.findall(ALNUM_WORD, lower(t)), set(), set()
        for k in range(1, 11):
            for j in range(len(w) - k + 1):
                if found := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    ids |= found
        return len(w), sorted(hit), sorted(ids)

    d, b = docs_of(spark, [(*x, None) for x in rows]), spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find(d, b, block_bytes=block_bytes).collect()
    assert sorted((x.doc_id, x.n_words, x.hits, x["items"]) for x in out) == sorted((i, *brute(t)) for i, t in rows)
    clean = decontam.clean(d, b, block_bytes=block_bytes)
    assert clean.columns == d.columns and clean.count() == sum(not brute(t)[1] for _, t in rows)
    assert decontam.find(d, b.limit(0)).where("n_hit > 0").count() == 0 and decontam.find(d.limit(0), b).count() == 0


# ---- 6 url filters


def test_url_filters(spark):
    r = random.Random(3)
    hosts = ["com", "example.com", "a.example.com", "notcom", "example.net", "x.y.example.net", "org", "COM", "example-com.com", "", "com.", "xcom"]
    rows = [(i, r.choice(["http://", "s://", "x"]) + r.choice(hosts) + r.choice(["", "/en/", "/en/7x", "/de/88", "/es/", "/en", "?q=/en/", "#/en/"]) + r.choice(["", "?a=://b", "#c"])) for i in range(600)] + [(1000, None), (1001, ""), (None, "http://com/en/"), (1, "http://com/en/"), (2000, "a\nhttp://com/en/\nb")]
    rows += [(3000 + i, "http://a.example.com/en/7") for i in range(200)]  # a hot url
    rules = [*Q.URL_RULES, ("block", "com", "en"), ("allow", "com", "/en/"), ("block", "", "/es/"), ("allow", "COM", "/en/7x"), ("allow", "x.y.example.net", "/de/88"), ("block", "example.com", "/en/7"), ("allow", "y.example.net", "")]

    def brute(u):
        host, _, rest = (u or "").partition("://")
        if u is None or "://" not in u:
            return "", "", None, "allow"
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        host, path = lower(m[1]), m[2]
        fits = [(len(h + p), v, h + p) for v, h, p in ((v, lower(h), p) for v, h, p in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[2], max(fits)[1]) if fits else (host, path, None, "allow")

    pages = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, path string")
    for runs in (1, 7):
        out = urls.judge(pages, urls.rule_table(spark, rules), runs=runs).collect()
        assert Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in out) == Counter((i, *brute(u)) for i, u in rows)
    assert urls.judge(pages, urls.rule_table(spark, rules[:0])).where("rule is not null").count() == 0
    assert urls.judge(pages.limit(0), urls.rule_table(spark, rules)).count() == 0


# ---- 7 mixing


def test_mixing(spark, corpus):
    d = docs_of(spark, corpus)
    out = mixing.mix(d).toPandas()
    size = Counter()
    for _, t, s in corpus:
        size[s] += len(re.findall(SPACE_WORD, t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    assert len(out) == len(corpus)
    for s, g in out.groupby(out.source.where(out.source.notna(), None), dropna=False):
        s = None if s is None or s != s else s
        assert g.target.iloc[0] == pytest.approx(target[s]) and g.source_size.iloc[0] == size[s]
        assert abs((g["size"] * g.copies).sum() - target[s]) <= g["size"].max() + 1
    assert out.copies.between(0, 2).all()
    full = mixing.mixed(d)
    assert full.columns == d.columns and full.count() == out.copies.sum()
    pd.testing.assert_frame_equal(*(mixing.mix(d.repartition(n)).toPandas().sort_values(["doc_id", "size", "copies"]).reset_index(drop=True) for n in (1, 3)))
    assert mixing.mix(d.limit(0)).count() == 0


# ---- 8 token ids


def test_token_ids(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    r = random.Random(2)
    pieces = ["a", "B", " ", "  ", "\n", "é", " é", "9", "!", "'s", " ", "\u3000", "\t", "word", " the", "<|im_start|>", "\x1c", "\r\n", "×"]
    rows = [(None, "x", None), (3, None, None), (3, None, None), (4, "", None), (5, "long word " * 20_000, None)] + [(10 + i, "".join(r.choice(pieces) for _ in range(r.randint(0, 60))), None) for i in range(300)]
    d = docs_of(spark, rows)
    tokens.write_tokens(d, str(tmp_path / "t"), path)
    want, start = {}, 0
    for i, t, _ in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    got = {}
    for x in tokens.digests(spark, str(tmp_path / "t")).orderBy("start").collect():
        got.setdefault(x.doc_id, []).append((x.start, x.n_tokens, x.ids_crc32))
    assert got == {k: [x[:3] for x in v] for k, v in want.items()}
    back = {(x.doc_id, x.start): x.tokens for x in tokens.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert back == {(k, x[0]): x[3] for k, v in want.items() for x in v}


def test_small_cache_changes_nothing(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = pa.array([f"some words {i} und mehr" for i in range(200)])
    whole = [tokens.Encoder(path).encode(r) for r in TX.runs(texts)][0]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    e = tokens.Encoder(path)
    parts = [e.encode(r)[0] for r in TX.runs(texts, 100)]
    assert np.concatenate(parts).tolist() == whole[0].tolist()


# ---- 9 quality rules


def brute_statistics(t):
    t = t or ""
    w = re.findall(SPACE_WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(SPACE_WORD, line):
            dup += line in seen
            seen.add(line)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


def test_statistics():
    r = random.Random(3)
    texts = [None, "", "\n\n", "a\na\n a\na", "a b c a b c", "x y x y x y", "w\n" * 50_000] + ["".join(r.choice("aB \n#é!") for _ in range(r.randint(0, 80))) for _ in range(400)]
    assert quality.statistics(pa.array(texts)).tolist() == [brute_statistics(t) for t in texts]
    assert quality.statistics(pa.array([], pa.string())).shape == (0, 5)


def brute_score(forest, s):
    """The anomaly score of a row by walking every tree, node by node."""
    n = max(1, s[0])
    x = [max(s[1 + i] / n, f) for i, f in enumerate(forest.floor)]
    paths = []
    for feature, split, path in zip(forest.feature.tolist(), forest.split.tolist(), forest.path.tolist(), strict=True):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + (2 if x[feature[node]] >= split[node] else 1)
        paths.append(path[node])
    m = forest.sample
    expected = 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    return 2 ** -(sum(paths) / len(paths) / expected)


def test_forest_keeps_clean_and_rejects_junk(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    good = [" ".join(word() for _ in range(r.randint(60, 200))) for _ in range(600)]
    bad = [" ".join(word() + r.choice(["###", "%%%"]) for _ in range(100)) for _ in range(90)]
    rows = [(i, t, None) for i, t in enumerate(good + bad)] + [(5000, None, None), (5001, "short", None), (5002, "a b c " * 100, None), (0, good[0], None)]
    labels = spark.createDataFrame([(i, int(i < 600), 0) for i in range(0, 690, 2)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    d = docs_of(spark, rows)
    forest = quality.fit(d, labels)
    out = {x.doc_id: x for x in quality.judge(d, forest).collect()}
    held_out = [i for i in range(1, 690, 2)]
    assert np.mean([out[i].kept for i in held_out if i < 600]) > 0.98 and np.mean([out[i].kept for i in held_out if i >= 600]) < 0.05
    assert all(out[i].base_failed and not out[i].kept for i in (5000, 5001, 5002))
    kept = quality.keep_good(d, forest)
    assert kept.columns == d.columns and kept.count() == sum(x.kept for x in quality.judge(d, forest).collect())
    again = quality.fit(d.repartition(3), labels)
    assert again.threshold == forest.threshold
    for x in quality.judge(d, forest).collect():
        s = [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words]
        assert x.score == pytest.approx(brute_score(forest, s))
        assert x.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and x.kept == (not x.base_failed and brute_score(forest, s) <= forest.threshold)
    assert quality.judge(d.limit(0), forest).count() == 0 and quality.keep_good(d.limit(0), forest).count() == 0
    by_name = quality.fit(d.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert 0 < by_name.threshold < 1
    with pytest.raises(ValueError, match="score"):
        quality.judge(d.withColumnRenamed("doc_id", "score"), forest, key="score")
    nothing = quality.fit(d, labels.limit(0))
    assert all(x.kept != x.base_failed for x in quality.judge(d, nothing).collect())


# ---- 10 chat


def chat_unescape(s):
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def test_chat_sql_states_the_operator(spark, tmp_path):
    odd = [None, "", "plain", "<|x", r"<\|", r"<\\|x|>", "<|im_end|>", "<|im_start|>", "<||>", "a <| b\nc", "<n>", "é😀<|"]
    roles = ["user", "assistant", None, "tool\nx", "<n>", r"<\n>", "<|", r"<\|", "<|im_start|>", "<|im_end|>"]
    r = random.Random(10)
    rows = [(c, t, r.choice(roles), r.choice(odd)) for c in range(150) for t in range(r.randint(1, 4))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.queries()["op10_chat_formatting"](spark, str(tmp_path)).toPandas().sort_values("conv_id").reset_index(drop=True)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(Q.oracle_sql()["op10_chat_formatting"]).df()[list(got.columns)].sort_values("conv_id").reset_index(drop=True)
    assert (got.astype(str) == want.astype(str)).all().all() and 0 < (got.n_escaped == 0).sum() < len(got)


def test_chat_round_trip(spark):
    odd = [None, "", "plain", "<|im_end|>", "a<|im_start|>user\nx<|im_end|>\n", r"<\|im_end\|>", r"<\\|x|>", "<||>", "\n", "<n>", r"<\n>", "é😀<|", "|><", "x" * 100_000]
    roles = ["user", "assistant", None, "tool\nx", "<n>", r"<\n>", "<|im_start|>", "assistant"]
    r = random.Random(9)
    rows = [(c, t, r.choice(roles), r.choice(odd)) for c in range(60) for t in r.sample([None, 0, 1, 1, 2, 3], 4)] + [(None, 0, "user", "x"), (1, 0, "user", "same"), (1, 0, "user", "same")]
    d = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(d).withColumns({"read": chat.parse(F.col("formatted")), "masked": chat.masked_text(F.col("formatted"), F.col("spans"))}).collect()
    want: dict = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {x.conv_id for x in out} == set(want)
    for x in out:
        turns = sorted(want[x.conv_id], key=lambda y: (y[0], y[1].encode(), y[2].encode()))
        assert x.identical and [(y.ok, y.role, y.text) for y in x.read] == [(True, *y[1:]) for y in turns]
        assert x.masked == "".join(y[2] for y in turns if y[1] == "assistant")
        assert x.formatted.count("<|im_start|>") == x.formatted.count("<|im_end|>\n") == len(turns)
    for x in out:  # spans are places in the whole conversation
        assert "".join(chat_unescape(x.formatted[s.start : s.start + s.length]) for s in x.spans) == x.masked
    plain = chat.format_chats(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")).first()
    assert plain.formatted == "<|im_start|>user\nhi<|im_end|>\n" and plain.n_escaped == 0
    assert chat.format_chats(d.limit(0)).count() == 0
    broken = spark.createDataFrame([("x<|im_start|>user\na<|im_end|>\n",), ("<|im_start|>user\na<|im_end|>b",), ("<|im_start|>user",)], "f string")
    assert all(not all(t.ok for t in x[0]) for x in broken.select(chat.parse(F.col("f"))).collect())


# ---- queries and the pipeline


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = Q.queries()[name](spark, sf_dir).toPandas(), c.sql(Q.oracle_sql()[name]).df()
    key = got.columns[0]
    got, want = (x[sorted(got.columns)].sort_values(key).reset_index(drop=True).astype(object).where(lambda y: y.notna(), None) for x in (got, want))
    assert got.equals(want) or (got.astype(str) == want.astype(str)).all().all()


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = Q.table(spark, sf_dir, "documents")
    columns, rows = docs.columns, docs.toPandas()
    kept = P.quality_rules(spark, docs, sf_dir)
    forest = quality.fit(docs, Q.table(spark, sf_dir, "labels"))
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, forest).collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and ids == {i for i, k in verdict.items() if k}
    kept = spark.createDataFrame(rows[rows.doc_id.isin(ids)].to_dict("records"), docs.schema)
    one = P.ngram_join(spark, kept, sf_dir)
    want, _ = brute_components([(r.doc_id, r.text) for r in kept.collect()])
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(i for i, c in want.items() if i == c)
    out = P.run(spark, sf_dir).toPandas()
    assert set(out.doc_id) <= set(want.values()) and sorted(out.shard.unique()) == list(range(8))
    assert out.groupby("doc_id").size().max() <= 2
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))



# ---- 3 license scans, 5 line dedup


def test_license_scan(spark):
    from chronolith.llm import licenses

    t = {"A": "one two three four five", "B": "One, TWO three four six!", "C": "solo", "empty": "?!"}
    rows = [(1, None), (2, ""), (3, "one two three four five"), (4, "junk\nONE two; three four five\n\nsolo"), (5, "one two three four"), (6, "word " * 50_000), (3, "one two three four five"), (None, "solo"), (7, "a\nb")]

    def grams(s):
        w = re.findall(ALNUM_WORD, lower(s))
        return {(a, b) for a, b in zip(w, w[1:], strict=False)} or {(x,) for x in w}

    def brute(s):
        if s is None:
            return 0, []
        lines = s.split("\n")
        segments = [s, *lines] if len(lines) > 1 else [s]
        out = []
        for i, seg in enumerate(segments):
            g = grams(seg)
            best = max(((2 * len(g & grams(x)) / (len(g) + len(grams(x))), -j, n) for j, (n, x) in enumerate(sorted(t.items())) if grams(x) and g), default=(0,))
            if best[0] >= 0.8:
                out.append((i, best[2], round(best[0], 6)))
        return len(segments), out

    got = licenses.scan(docs_of(spark, [(*x, None) for x in rows]), t).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x.doc_id, x.n_segments, [(m.segment, m.license, round(m.dice, 6)) for m in x.matches]) for x in got), key=key) == sorted(((i, *brute(s)) for i, s in rows), key=key)
    assert licenses.scan(docs_of(spark, [(1, "solo", None)]), {}).first().matches == []


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_line_dedup(spark, block):
    from chronolith.llm import lines

    r = random.Random(8)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "é"]
    rows = [(i, "\n".join(r.choice(["", " "]) + r.choice(pool[: 3 + i % 13]) for _ in range(r.randint(0, 8))), f"s{r.randint(0, 9)}" if i % 9 else None) for i in range(120)]
    rows += [(500, None, "s1"), (501, "", "s1"), (502, "line 0\n" * 20_000, "s2"), (3, rows[3][1], rows[3][2])]
    sites: dict[str, set] = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip():
                sites.setdefault(x.strip(), set()).add(s)
    gone = {x for x, s in sites.items() if len(s) >= 8}
    assert 0 < len(gone) < len(sites)

    def brute(t):
        if t is None:
            return None, 0, 0
        kept = [x for x in t.split("\n") if x.strip() not in gone]
        n = t.count("\n") + 1
        return (t if len(kept) == n else "\n".join(kept)), n, n - len(kept)

    d = docs_of(spark, rows)
    out = lines.drop_boilerplate(d, 8, block_lines=block)
    assert out.columns == [*d.columns, "n_lines", "n_removed"]
    assert Counter((x.doc_id, x.text, x.n_lines, x.n_removed) for x in out.collect()) == Counter((i, *brute(t)) for i, t, _ in rows)
    assert lines.drop_boilerplate(d.limit(0), 8).count() == 0
