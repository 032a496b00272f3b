"""Shards and index: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldwise.llm import token_files, tokens
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = "word_bpe_49k.json"


def test_perfect_hash_is_minimal():
    hashes = np.random.default_rng(1).integers(0, 2**63, 30_000).astype(np.uint64)
    made = token_files.PerfectHash.build(hashes)
    made = token_files.PerfectHash.from_arrays(made.arrays())
    assert sorted(made.slots(hashes).tolist()) == list(range(len(hashes)))
    bits = sum(len(level) for level in made.levels) / len(hashes)
    assert bits < 4
    assert token_files.PerfectHash.build(hashes[:0]).slots(hashes[:3]).tolist() == [-1, -1, -1]


def test_keys_that_find_no_place_are_listed(monkeypatch):
    monkeypatch.setattr(token_files, "LEVELS", 1)
    hashes = np.arange(1000, dtype=np.uint64)
    made = token_files.PerfectHash.build(hashes)
    assert len(made.rest) and sorted(made.slots(hashes).tolist()) == list(range(1000))


def test_query_equals_plain_encoding(spark):
    own = Tokenizer.from_file(public_tokenizers.path(WORD))
    own.encode_special_tokens = True
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, start = {}, 0
    for doc, text in docs:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = QUERIES["op5_token_files"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("width", [2, 4])
def test_keyed_access_of_hard_rows(spark, hard, width):
    definition = tokens.read_definition(public_tokenizers.path(WORD))
    root = token_files.write_token_files(hard, "doc_id", "text", definition, "words", 2, width, shards=3)
    places = token_files.read_documents(spark, root)
    assert places.count() == hard.count()
    asked = spark.createDataFrame([(0,), (6,), (None,), (12345,)], "id long")
    found = token_files.read_ids(root, token_files.look_up(spark, root, asked), with_ids=True).collect()
    assert sorted((r.id is None, r.id) for r in found) == [(False, 0), (False, 6), (True, None)]
    again = asked.selectExpr("id", "1 AS copy")
    assert sorted((r.id is None, r.id) for r in token_files.look_up(spark, root, again).collect()) == [
        (False, 6),
        (True, None),
    ]
    own = Tokenizer.from_file(public_tokenizers.path(WORD))
    plain = own.encode("A plain text of some ten words or a few more.", add_special_tokens=False).ids
    assert next(list(r.ids) for r in found if r.id == 0) == [*plain, 2]


def test_empty_table(spark, empty):
    definition = tokens.read_definition(public_tokenizers.path(WORD))
    root = token_files.write_token_files(empty, "doc_id", "text", definition, "words", 2, shards=2)
    keys = spark.createDataFrame([(1,)], "id long")
    assert token_files.look_up(spark, root, keys).collect() == []


def test_a_wrong_shard_is_refused(spark, hard, tmp_path):
    definition = tokens.read_definition(public_tokenizers.path(WORD))
    root = token_files.write_token_files(
        hard.limit(1), "doc_id", "text", definition, "words", 2, shards=1, root=str(tmp_path / "set")
    )
    for shard in (tmp_path / "set").glob("ids-*.bin"):
        shard.write_bytes(b"something else entirely")
    keys = spark.createDataFrame([(0,)], "id long")
    with pytest.raises(Exception, match="no shard of token ids"):
        token_files.read_ids(root, token_files.look_up(spark, root, keys)).collect()
