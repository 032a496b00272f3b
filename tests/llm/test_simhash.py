"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash

from foldwise.llm import simhash
from foldwise.llm.components import connected_components


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    group = {n: n for n in nodes}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {n: top(n) for n in nodes}


def test_every_four_positions_hold_a_key():
    for width in (3, 4):
        keys = [set(k) for k in simhash.index_positions(width)]
        fours = simhash.index_positions(4)
        assert all(any(k <= set(four) for k in keys) for four in fours)
    assert len(simhash.index_positions(3)) == 20


def test_groups_equal_brute_force(spark, hard):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [t.replace("aaa", "zzz", 1) for t in texts] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for max_bits, width in ((4, 3), (4, 4), (2, 3)):
        got = simhash.near_groups(docs, "doc_id", "text", max_bits=max_bits, bytes_per_key=width).collect()
        own = {i: fingerprint(t) for i, t in enumerate(texts)}
        assert all(own[r.id] == r.fingerprint % 2**64 for r in got)
        group = components(sorted(set(own.values())), lambda a, b: (a ^ b).bit_count() <= max_bits)
        least = {}
        for i in sorted(own):
            least.setdefault(group[own[i]], i)
        assert {r.id: r.component_id for r in got} == {i: least[group[own[i]]] for i in own}


def test_long_index_lists_are_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    flips = [sum(1 << int(b) for b in rng.choice(16, 5, replace=False)) for _ in range(150)]
    values = sorted({(0x0123456789AB0000 ^ f) for f in flips})
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    want = components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    found = {r.node: r.component for r in connected_components(simhash.near_links(frame)).collect()}
    assert {v: found.get(v, v) for v in values} == want


def test_hard_rows(hard, empty):
    rows = simhash.near_groups(hard, "doc_id", "text").collect()
    assert len(rows) == hard.count()
    assert all(r.component_id == 2 for r in rows if r.fingerprint == 0)
    assert {r.component_id for r in rows if r.id in (0, 1)} == {0}
    assert simhash.near_groups(empty, "doc_id", "text").collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    links = spark.createDataFrame(chain, "src long, dst long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(links.where("false")).collect() == []
