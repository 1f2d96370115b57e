"""Token files: ids as the tokenizers library gives them, encodings, row groups, page indexes and selective reads."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronolith.llm import text as TX
from chronolith.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(encoder, texts, size):
    out = []
    for run in TX.runs(pa.array(texts), size):
        ids, n = encoder.encode(run)
        bounds = [0, *n.cumsum().tolist()]
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    return out


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_special_tokens_of_the_file(path, size):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    r = random.Random(0)
    bits = ["<|endoftext|>"] * 3 + ["<|endof", "text|>", "<|im_start|>", " ", "  ", "\n", "\t", "a", "word", " the", "é", "!", "9", "'s", "<", "|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["<|endoftext|> z", "a <|endoftext|>", "in<|endoftext|>side", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n\ny", "<|endoftext", "|>", ""]
    assert encoded(tokens.Encoder(path), texts, size) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("odd", [{"lstrip": True}, {"single_word": True}, {"rstrip": True}, {}])
def test_added_tokens_that_take_white_space(path, tmp_path, odd):
    from tokenizers import AddedToken, Tokenizer

    model = Tokenizer.from_file(path)
    model.add_tokens([AddedToken("the", **odd), AddedToken("<x>", **odd)])
    model.save(str(tmp_path / "t.json"))
    texts = ["in the end", "other  the<x>", "the", "<x> a the  <x>", "no such", "<X>"]
    assert encoded(tokens.Encoder(str(tmp_path / "t.json")), texts, 1 << 20) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_files_allow_selective_reads(spark, tmp_path, path, monkeypatch):
    monkeypatch.setattr(tokens, "ROW_GROUP", 64 << 10)
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randint(0, 5000)}" for _ in range(120)), "clash") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, tokens string").coalesce(1)
    tokens.write_tokens(d, str(tmp_path / "t"), path)
    files = [pq.ParquetFile(f).metadata for f in sorted(Path(tmp_path / "t").glob("*.parquet")) if pq.ParquetFile(f).metadata.num_rows]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert len(groups) > 2 * len(files)
    for g in groups:
        columns = {g.column(i).path_in_schema.split(".")[0]: g.column(i) for i in range(g.num_columns)}
        assert {"part", "before", "n_tokens", "doc_id", "tokens"} == {*columns}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert {*columns["tokens"].encodings} & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} and "DELTA_BINARY_PACKED" in columns["before"].encodings
        assert columns["doc_id"].statistics.max < min((h.column(3).statistics.min for h in groups if h.column(3).statistics.min > columns["doc_id"].statistics.min), default=1 << 40)
    whole = {x.doc_id: x for x in tokens.read_tokens(spark, str(tmp_path / "t")).collect()}
    some = tokens.read_tokens(spark, str(tmp_path / "t"), keys=(1500, 1501))
    assert {x.doc_id: x for x in some.collect()} == {k: whole[k] for k in (1500, 1501)}
    assert "GreaterThanOrEqual(doc_id,1500)" in some._jdf.queryExecution().executedPlan().toString()
    sizes = tokens.read_sizes(spark, str(tmp_path / "t"))
    assert {x.doc_id: (x.start, x.n_tokens) for x in sizes.collect()} == {k: (x.start, len(x.tokens)) for k, x in whole.items()}
    assert "tokens:array" not in sizes._jdf.queryExecution().executedPlan().toString()


def test_odd_tables(spark, tmp_path, path):
    d = spark.createDataFrame([], "doc_id long, text string")
    tokens.write_tokens(d, str(tmp_path / "e"), path)
    assert tokens.digests(spark, str(tmp_path / "e")).collect() == [] and tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0
    one = spark.createDataFrame([("k", None), (None, "a")], "id string, text string")
    tokens.write_tokens(one, str(tmp_path / "s"), path, end_id=7, key="id")
    assert [(x.id, x.start, x.tokens) for x in tokens.read_tokens(spark, str(tmp_path / "s"), "id").orderBy("start").collect()] == [(None, 0, [64, 7]), ("k", 2, [7])]
    with pytest.raises(ValueError, match="part"):
        tokens.write_tokens(one.withColumnRenamed("id", "part"), str(tmp_path / "x"), path, key="part")
