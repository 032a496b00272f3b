"""Repeated passages against brute force."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from foldwise.llm import repeats
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def lines_of(text):
    """``(start, words)`` of the lines of a text, in words."""
    at = 0
    for line in (text or "").lower().split("\n"):
        words = tuple(line.split())
        if words:
            yield at, words
        at += len(words)


def shingles(words):
    size = min(5, len(words))
    return {words[k : k + size] for k in range(len(words) - size + 1)}


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def similar_pairs(lines):
    """All pairs of distinct lines at a Jaccard of 0.8 or more, by brute force over shared shingles."""
    sets = {words: shingles(words) for words in lines}
    holders = defaultdict(list)
    for words, own in sets.items():
        for shingle in own:
            holders[shingle].append(words)
    met = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    return [(a, b) for a, b in met if near(sets[a], sets[b])]


def test_query_against_brute_force(spark):
    rows = QUERIES["op9_repeated_passages"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    places = defaultdict(set)
    for doc, text in texts.items():
        for start, words in lines_of(text):
            places[words].add((doc, start))
    pairs = similar_pairs(places)
    classes, members = {}, defaultdict(list)
    for r in rows:
        members[r.kind, r.class_id].append(r)
        words = tuple((texts[r.doc_id] or "").lower().split()[r.start : r.start + r.n_words])
        if r.kind == "line":
            assert (r.doc_id, r.start) in places[words]
            classes[words] = r.class_id
        else:
            assert len(words) == repeats.WORDS
    # Every line that documents share is there, each time it stands.
    found = {(r.doc_id, r.start) for r in rows if r.kind == "line"}
    shared = [p for p in places.values() if len({doc for doc, _ in p}) > 1]
    assert len(shared) > 100 and all(p <= found for p in shared)
    assert any(len(words) < 5 for words in classes)
    across = [(a, b) for a, b in pairs if len({doc for doc, _ in places[a] | places[b]}) > 1]
    linked = [(a, b) for a, b in across if a in classes and classes[a] == classes.get(b)]
    assert len(across) > 30 and len(linked) >= 0.95 * len(across)
    like = defaultdict(set)
    for a, b in pairs:
        like[a].add(b)
        like[b].add(a)
    for (kind, _), own in members.items():
        assert len({r.doc_id for r in own}) > 1
        assert {r.n_links for r in own} == {len(own) - 1}
        assert [r.keep for r in sorted(own, key=lambda r: (r.doc_id, r.start))] == [True] + [False] * (len(own) - 1)
        words = {tuple(texts[r.doc_id].lower().split()[r.start : r.start + r.n_words]) for r in own}
        assert len(words) == 1 or kind == "line" and all(like[w] & words for w in words)


def test_query_finds_every_document_that_shares_forty_words(spark):
    rows = QUERIES["op9_repeated_passages"](spark, SF).collect()
    holders = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = (r.text or "").lower().split()
        for k in range(len(words) - 39):
            holders[tuple(words[k : k + 40])].add(r.doc_id)
    sharing = {doc for own in holders.values() if len(own) > 1 for doc in own}
    assert len(sharing) > 50 and sharing <= {r.doc_id for r in rows if r.kind == "stretch"}


def test_jaccard_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 40, (6, 16))
    table = np.concatenate([np.where(rng.random((12, 16)) < 0.1, rng.integers(0, 40, (12, 16)), row) for row in base])
    content = np.arange(len(table))
    sets = [set(row) for row in table.tolist()]
    links = repeats.jaccard_links(content, table.astype(np.uint64), 0.8)
    group = {i: {i} for i in content}

    def merge(pairs):
        own = {i: i for i in content}

        def top(i):
            while own[i] != i:
                i = own[i]
            return i

        for a, b in pairs:
            x, y = sorted((top(a), top(b)))
            own[y] = x
        return [top(i) for i in content]

    every = [(i, j) for i in content for j in content if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert merge(links) == merge(every) and len(links) < len(content) and group
    assert repeats.bands_for(0.8, 3, 0.95) == 5 and repeats.bands_for() == 6


def test_hard_rows(spark, hard, empty):
    rows = repeats.repeated_passages(hard, "doc_id", "text").collect()
    assert {(r.id, r.kind, r.n_links, r.keep) for r in rows} == {(0, "line", 1, True), (1, "line", 1, False)}
    five = hard.where("doc_id = 5")
    twice = five.unionByName(five.withColumn("doc_id", F.lit(9).cast("long"))).unionByName(hard.where("doc_id is null"))
    found = repeats.repeated_passages(twice, "doc_id", "text").collect()
    assert {r.id for r in found if r.keep} == {5} and {r.id for r in found} == {5, 9}
    assert {r.kind for r in found} == {"line", "stretch"}
    assert repeats.repeated_passages(empty, "doc_id", "text").collect() == []


def test_inline_passages_near_lines_and_clean_documents(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    docs, inline, lines, k = [], set(), [], 0
    for trial in range(200):
        edited = trial % 2
        passage = some(rng.randrange(50, 71) if edited else rng.randrange(40, 71))
        other = list(passage)
        for _ in range(rng.randrange(1, 3) if edited else 0):
            at, kind = rng.randrange(len(other)), rng.randrange(3)
            other[at : at + (kind != 1)] = [f"edit{trial}"] if kind < 2 else []
        gap = "\n" if edited else " "
        for p in (passage, other):
            docs.append((k, gap.join(" ".join(x) for x in (some(rng.randrange(5, 60)), p, some(30)))))
            k += 1
        if not edited:
            inline |= {k - 2, k - 1}
        elif near(shingles(tuple(passage)), shingles(tuple(other))):
            lines.append((k - 2, k - 1))
    docs += [(10_000 + d, " ".join(some(200))) for d in range(50)]
    docs += [(20_000, "only here\n" + "\n".join(["again and again and " * 8] * 9))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = repeats.repeated_passages(frame, "doc_id", "text").collect()
    assert inline <= {r.id for r in rows if r.kind == "stretch"}
    classes = defaultdict(set)
    for r in rows:
        if r.kind == "line":
            classes[r.id].add(r.class_id)
    linked = [pair for pair in lines if classes[pair[0]] & classes[pair[1]]]
    assert len(lines) > 40 and len(linked) >= 0.95 * len(lines)
    assert not {r.id for r in rows if r.id >= 10_000}


def test_a_band_of_many_lines_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TILE_ROWS", 16)
    rng = random.Random(2)
    line = [f"w{i}" for i in range(60)]
    docs = []
    for doc in range(300):
        own = list(line)
        own[rng.randrange(60)] = f"edit{doc}"
        docs.append((doc, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [r for r in repeats.repeated_passages(frame, "doc_id", "text").collect() if r.kind == "line"]
    assert {(r.class_id, r.n_links) for r in rows} == {(rows[0].class_id, 299)} and len(rows) == 300


def test_band_keys_do_not_depend_on_the_text_around():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**62, 9000).astype(np.uint64)
    edges = np.concatenate([[0], np.sort(rng.choice(np.arange(1, 9000), 5000, replace=False)), [9000]])
    whole = repeats.band_keys(own, edges, 3, 6)
    for k in (0, 7, 4095, 4096, 5000):
        a, b = edges[k], edges[k + 1]
        assert (whole[k] == repeats.band_keys(own[a:b], np.array([0, b - a]), 3, 6)[0]).all()
