"""Two tokenizers' groups and links, against the plain tokenizers and a loop."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foldwise.llm import alignment, tokens
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DEFINITION = tokens.read_definition(public_tokenizers.path("byte_bpe_50k.json"))
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def plain_groups(texts):
    first = Tokenizer.from_str(DEFINITION)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    entries = tokens.byte_level_entries(DEFINITION)
    for text in texts:
        if not text:
            yield []
            continue
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        pieces = [second.id_to_piece(i) for i in b]
        of_a = [entries[i] for i in a]
        of_b = [
            bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(b, pieces, strict=True)
        ]
        if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            yield []
            continue
        groups, end_a, end_b, i, j = [], 0, 0, 0, 0
        one = ([], [])
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                one[0].append(a[i])
                end_a += len(of_a[i])
                i += 1
            else:
                one[1].append(b[j])
                end_b += len(of_b[j])
                j += 1
            if end_a == end_b:
                groups.append(one)
                one = ([], [])
        yield groups


def expected(rows):
    made = list(plain_groups(text for _, text in rows))
    held, highest = Counter(), defaultdict(int)
    for groups in made:
        held.update({(a, b) for x, y in groups for a in x for b in y})
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    out = []
    for (key, _), groups in zip(rows, made, strict=True):
        links = [(a, b) for x, y in groups for a in x for b in y]
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append(
            (
                key,
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                len(links),
                sum(held[p] == highest[p[0]] for p in links),
                sum(held[p] for p in links),
                hashlib.sha256(shown.encode()).hexdigest() if shown else "",
            )
        )
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


HARD = [
    "two  spaces   and more    end ",
    " begins with one",
    "\n\nlines\r\n\ttabs \n and \n breaks",
    "literal ▁ mark",
    "<|endoftext|> </s> <0x41> [UNK]",
    "日本語のテキスト と 😀😀 emoji‍",
    "a" * 9000,
    "ab " * 4000 + "x" * 500 + " end. " * 900,
    "é ́ composed \x00 null",
    "　wide line \xa0no-break",
    "§" * 3000 + "the " * 1000 + "=-=-" * 700,
]


def test_query_equals_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(QUERIES["op11_fragment_alignment"](spark, SF))
    assert got == expected([(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("chunk_bytes", [7, 64, 1000, 1 << 20])
def test_ranges_of_any_size_give_the_same(spark, hard, chunk_bytes):
    rows = [(r.doc_id, r.text and r.text[:6000]) for r in hard.select("doc_id", "text").collect()]
    rows += [(100 + i, text[:2500] if chunk_bytes < 64 else text) for i, text in enumerate(HARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.align_documents(docs, "doc_id", "text", DEFINITION, MODEL, chunk_bytes)
    assert rows_of(got) == expected(rows)


def test_hard_rows_groups_and_no_rows(spark, hard, empty):
    got = alignment.align_documents(hard, "doc_id", "text", DEFINITION, MODEL, with_groups=True).collect()
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    assert sorted([tuple(r)[:-1] for r in got], key=repr) == expected(rows)
    for r in got:
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
    assert alignment.align_documents(empty, "doc_id", "text", DEFINITION, MODEL).collect() == []


def test_composition_is_associative():
    rng = np.random.default_rng(3)

    def fragment():
        part = lambda: rng.integers(0, 9, rng.integers(0, 4))
        has = bool(rng.integers(0, 2))
        none = np.zeros(0, np.int64)
        return (has, part(), part(), part() if has else none, part() if has else none)

    def shown(fragment, groups):
        return [fragment[0], *(x.tolist() for x in fragment[1:])], [
            [x.tolist() for x in g] for g in groups if g is not None
        ]

    for _ in range(200):
        a, b, c = fragment(), fragment(), fragment()
        ab, first = alignment.compose(a, b)
        left, second = alignment.compose(ab, c)
        bc, third = alignment.compose(b, c)
        right, fourth = alignment.compose(a, bc)
        assert shown(left, [first, second]) == shown(right, [fourth, third])
