"""Code lengths against a tree walked byte by byte, and held-out accuracy."""

import math
import zlib
from collections import Counter

import pytest

from foldwise.llm import languages
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_bits(samples, text, order):
    """Escape by escape, from counts of strings."""
    seen = Counter()
    for sample in samples:
        data = sample.encode()
        for length in range(1, order + 2):
            seen.update(data[i : i + length] for i in range(len(data) - length + 1))
    follow = {}
    for string, n in seen.items():
        follow.setdefault(string[:-1], {})[string[-1]] = n
    data, bits = text.encode(), 0.0
    for i, byte in enumerate(data):
        for size in range(min(order, i), -1, -1):
            after = follow.get(data[i - size : i], {})
            n, q = sum(after.values()), len(after)
            if byte in after:
                bits -= math.log2(after[byte] / (n + q))
                break
            if n:
                bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


SAMPLES = {
    "aa": ["banana bandana", "an ant and a bat", "x"],
    "bb": ["le chat noir", "élan vital, déjà vu", ""],
    "cc": ["ababababab", "ba"],
}


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_are_exact(spark, order, monkeypatch):
    rows = [(lang, text) for lang, texts in SAMPLES.items() for text in texts]
    sample = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    trees = languages.freeze_trees(languages.count_strings(sample, order).toArrow(), order)
    texts = ["banana", "un chat", "déjà", "abba", "zzz \x00", "☃ snow", "a", "bandana élan " * 40]
    for window in (7, 1 << 19):
        monkeypatch.setattr(languages, "WINDOW_BYTES", window)
        for lang in SAMPLES:
            for text in texts:
                got = languages.code_length(trees, text, lang)
                assert got == pytest.approx(plain_bits(SAMPLES[lang], text, order), rel=1e-12)


def test_predicts_held_out_languages(spark):
    got = QUERIES["op13_partial_matching"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
    known = [r for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    right = [r.lang_pred == docs[r.doc_id].lang for r in known]
    assert len(right) > 200 and sum(right) / len(right) > 0.98


def test_many_texts_at_once_equal_each_alone(spark, hard):
    rows = [("aa", "some plain english words of text"), ("bb", "quelques mots de texte"), (None, "no")]
    fit = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows * 5)], "id long, text string, lang string")
    trees = languages.fit_languages(fit, "id", "text", "lang", order=3)
    assert languages.learnt(trees) == ("aa", "bb")
    got = languages.predict_languages(trees, hard, "doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    want = []
    for key, text in texts:
        if not any(c.isalpha() for c in text or ""):
            want.append((key, "und", 0.0))
            continue
        bits = [languages.code_length(trees, text, lang) for lang in ("aa", "bb")]
        score = 1 / (1 + 2.0 ** -abs(bits[0] - bits[1]))
        want.append((key, "aa" if bits[0] <= bits[1] else "bb", round(score, 9)))
    assert sorted([(r.id, r.lang_pred, round(r.score, 9)) for r in got], key=repr) == sorted(want, key=repr)


def test_nothing_learnt_and_no_rows(spark, hard, empty):
    none = hard.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert languages.fit_languages(none, "doc_id", "text", "lang") is None
    got = languages.predict_languages(None, hard, "doc_id", "text").collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == hard.count()
    trees = languages.fit_languages(hard.withColumn("lang", hard.label), "doc_id", "text", "lang")
    assert languages.predict_languages(trees, empty, "doc_id", "text").collect() == []
