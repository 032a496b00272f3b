"""Packing: nothing lost, nothing overfull, and close to the fewest sequences."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foldwise.llm import packing, tokens
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BYTE = "byte_bpe_50k.json"


def plain(name, texts):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.encode_special_tokens = True
    return [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def definition(name):
    return tokens.read_definition(public_tokenizers.path(name))


@pytest.mark.parametrize(("name", "mode"), [(BYTE, "spaces"), ("word_bpe_49k.json", "words")])
def test_remembered_parts_give_the_tokenizers_ids(name, mode):
    rng = np.random.default_rng(6)
    bits = [" ", "  ", "\n", "\t", "\u00a0", "\u2028", "a", "é", "e\u0301", "'s", "0", "10", "²", "ß", "İ",
            "Σ", ".", ",", "...", "😀", "<|endoftext|>", "\x85", " word", "Don't", " .", "\r\n", "½"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(2000)] + [None, "", " "]
    own = tokens.Encoder(definition(name), mode)
    assert [x.tolist() for x in own.encode(pa.array(texts))] == plain(name, texts)
    assert own.encode(pa.array([], pa.string())) == []


def test_plans_use_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(1)
    for lengths in (
        rng.integers(1, 1025, 20_000),
        np.minimum(1024, rng.lognormal(6, 1, 5000)).astype(int).clip(1),
        rng.integers(600, 1025, 300),
        rng.integers(1, 5, 2000),
        np.array([1024]),
    ):
        counts = {int(a): int(n) for a, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.plan_packing(counts)
        used: dict[int, int] = {}
        for times, own in plan:
            assert sum(own) <= 1024
            for length in own:
                used[length] = used.get(length, 0) + times
        assert used == counts
        least = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert sum(times for times, _ in plan) <= 1.01 * least + 2


def test_exact_fills_are_found_as_brute_force_finds_them():
    rng = np.random.default_rng(2)
    for _ in range(300):
        available = (rng.random(31) < 0.25).astype(int) * rng.integers(1, 3, 31)
        available[0] = 0
        gap = int(rng.integers(1, 31))
        index = packing.SumIndex(available.copy())
        there = np.repeat(np.arange(31), available).tolist()
        pairs = {a + b for i, a in enumerate(there) for b in there[i + 1 :]}
        triples = {
            a + b + c for i, a in enumerate(there) for j, b in enumerate(there[i + 1 :], i + 1) for c in there[j + 1 :]
        }
        assert (index.pair(gap) is not None) == (gap in pairs)
        assert (index.triple(gap) is not None) == (gap in triples)


def check(rows, ids):
    sequences, pieces = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, own in pieces.items():
        at = 0
        for number, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (number, at) and (number == 0 or length == 1024)
            at += length
        assert at == len(ids[doc])
    return len(sequences)


def test_query_packs_every_document(spark):
    rows = QUERIES["op4_complement_packing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    made = plain(BYTE, [r.text for r in docs])
    ids = {r.doc_id: np.array([*own, 2], "<u4") for r, own in zip(docs, made, strict=True)}
    assert {r.doc_id for r in rows} == set(ids)
    assert check(rows, ids) <= 1.01 * sum(map(len, ids.values())) / 1024 + 1


def test_hard_rows_and_ids(hard, empty):
    args = ("doc_id", "text", definition(BYTE), "spaces", 2)
    rows = packing.pack_documents(hard, *args, with_ids=True).collect()
    assert sorted(r.length for r in rows if r.id in (2, 3)) == [1, 1]
    assert all(len(r.ids) == r.length and r.ids[-1] == 2 for r in rows if r.length < 1024 and r.id != 5)
    places = sorted((r.sequence_id, r.offset) for r in rows)
    assert len(set(places)) == len(places)
    assert packing.pack_documents(empty, *args).collect() == []
