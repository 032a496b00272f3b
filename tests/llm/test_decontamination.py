"""Benchmark search against brute-force edit distances."""

import random

import numpy as np

from foldwise.llm import decontamination as dec

SF = "/root/testdata/sf0.01"


def edits_by_hand(item, stretch):
    """Least edits to any part of ``stretch``: the textbook table."""
    row = [0] * (len(stretch) + 1)
    for k, a in enumerate(item):
        new = [k + 1]
        for j, b in enumerate(stretch):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_best_edits_equals_the_table():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item, stretch = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        edits, a, b = dec.best_edits(item, stretch)
        assert edits == edits_by_hand(list(item), list(stretch))
        assert 0 <= a <= b <= len(stretch)
        if b > a:
            assert edits_by_hand(list(item), list(stretch[a:b])) == edits


def planted(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = "changed"
        elif kind == 1:
            words.insert(at, "added")
        else:
            del words[at]
    return words


def test_recall_and_precision_against_brute_force():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 60)))) for i in range(25)]
    matcher = dec.Matcher(items)
    texts = []
    for k in range(200):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        words = items[k % 25][1].split()
        at = rng.randrange(len(body) + 1)
        body[at:at] = planted(rng, words, rng.randrange(0, int(0.3 * len(words))))
        texts.append(" ".join(body))
    got = matcher.matches([matcher.symbols(t) for t in texts])
    found = wanted = both = 0
    for text, hits in zip(texts, got, strict=True):
        words = text.split()
        own = {i for i, *_ in hits}
        true = {i for i, t in items if edits_by_hand(t.split(), words) <= int(0.2 * len(t.split()))}
        found, wanted, both = found + len(own), wanted + len(true), both + len(own & true)
    assert both == found  # every reported item is verified
    assert wanted > 100 and both >= 0.98 * wanted


def test_buckets_drop_unrelated_windows_and_keep_edited_items(spark):
    rng = random.Random(4)
    items = sorted(map(tuple, spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    prose = [word for text in texts for word in dec.words_of(text)]
    matcher = dec.Matcher(items)

    def some(n):
        at = rng.randrange(len(prose) - n)
        return prose[at : at + n]

    def collide(symbols, sizes, wanted=None):
        samples = dec.cgk_samples(matcher._padded(symbols), np.array(sizes), matcher.places)
        keys, whole = dec._keys(samples, np.array(sizes)), (samples >= 0).all(axis=2)
        for k, row in enumerate(keys):
            own = row[whole[k]]
            found = {int(i) for x in own for i in matcher.key_items[matcher.keys == x]}
            yield bool(found) if wanted is None else wanted[k] in found

    sizes = [int(rng.choice(matcher.sizes)) for _ in range(500)]
    unrelated = [matcher.symbols(" ".join(some(n))) for n in sizes]
    assert np.mean(list(collide(unrelated, sizes))) <= 0.1
    hits = []
    for k in [*range(len(items))] * 5:
        words = dec.words_of(items[k][1])
        edited = " ".join(planted(rng, words, int(0.2 * len(words))))
        symbols = matcher.symbols(" ".join([*some(20), edited, *some(20)]))
        near = [(a - off, n) for a, off, n in matcher._windows(symbols).tolist() if n == len(words)]
        cut = [symbols[max(a, 0) : a + n] for a, n in near]
        hits.append(any(collide(cut, [n for _, n in near], [k] * len(near))) if near else False)
    assert len(hits) >= 100 and np.mean(hits) >= 0.98  # tuned to 0.99 on other edits


def test_short_items_and_scripts_without_spaces():
    items = [(1, "alone"), (2, "two words"), (3, "one two three four"), (4, "机器学习模型"), (5, "...")]
    matcher = dec.Matcher(items)
    texts = ["not Alone, here", "two other words", "Two, words!", "so one two three four five", "one two three four",
             "他们训练机器学习模型的时候", "机器 学习", "", "ภาษาไทย", "two changed three four"]
    got = matcher.matches([matcher.symbols(t) for t in texts])
    found = [{matcher.ids[i] for i, *_ in hits} for hits in got]
    assert found == [{1}, set(), {2}, {3}, {3}, {4}, set(), set(), set(), set()]


def test_query_and_hard_rows(spark, hard, empty):
    passage = "A plain text of some ten words or a few more."
    rows = [(1, passage), (2, None), (None, ""), (3, "too short"), (4, passage), (5, "me at example")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    args = ("doc_id", "text", "item_id", "text")
    got = dec.find_passages(hard, items, *args).collect()
    assert sorted((r.id, r.item_id, r.edits) for r in got) == [(0, 1, 0), (0, 4, 0), (1, 1, 0), (1, 4, 0)]
    assert all((r.start, r.end) == (0, len(passage) - 1) for r in got)
    assert dec.find_passages(empty, items, *args).collect() == []
    assert dec.find_passages(hard, items.where("false"), *args).collect() == []
    flag = dec.is_contaminated(items, "item_id", "text", hard.text)
    assert sorted(r.doc_id for r in hard.where(flag).collect()) == [0, 1]


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(dec, "ITEMS_PER_PASS", 2)
    items = [(i, " ".join(f"v{i}x{j}" for j in range(10))) for i in range(7)]
    docs = [(i, f"before {t} behind") for i, t in items]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(items, "item_id long, text string")
    got = dec.find_passages(frame, known, "doc_id", "text", "item_id", "text").collect()
    assert sorted((r.id, r.item_id) for r in got) == [(i, i) for i in range(7)]
