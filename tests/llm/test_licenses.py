"""Licence paragraphs against the lines that are planted in the test tables."""

import math

from foldwise.llm import licenses
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PLANTED = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "All rights reserved.": "reserved",
}


def test_query_equals_a_scan_for_the_planted_lines(spark):
    rows = QUERIES["op3_license_paragraphs"](spark, SF).collect()
    want = [
        (r.doc_id, number, PLANTED[line])
        for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
        for number, line in enumerate((r.text or "").split("\n"))
        if line in PLANTED
    ]
    assert sorted((r.doc_id, r.paragraph, r.family) for r in rows) == sorted(want)
    assert all(r.confirmed and r.probability >= 0.5 for r in rows)


def test_unknown_paragraphs_and_hard_rows(spark, hard, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.fit_licenses(docs, "text")
    texts = [
        "We stand by the table and talk of the weather.\nLicensed under the apache license version 2.0",
        "The version of the story that is free of charge",
        "release the software",
        "Permission is granted, free of charge, to any person obtaining a copy of this software and associated files.",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(rows, model, "doc_id", "text").collect()
    found = {(r.id, r.paragraph): (r.family, r.confirmed) for r in got if r.confirmed}
    assert found == {(0, 1): ("Apache-2.0", True), (3, 0): ("MIT", True)}
    assert licenses.scan_licenses(hard, model, "doc_id", "text").collect() == []
    assert licenses.scan_licenses(empty, model, "doc_id", "text").collect() == []
    bare = licenses.fit_licenses(empty, "text")
    assert [r.family for r in licenses.scan_licenses(rows, bare, "doc_id", "text").collect() if r.paragraph == 1] == ["Apache-2.0"]


def test_words_of_notices_in_ordinary_text_hide_no_notice(spark):
    words = sorted({w for ns in licenses.NOTICES.values() for n in ns for w in licenses._words(n)})
    docs = [(k, f"people spoke of {words[k % len(words)]} and the weather in town {k}") for k in range(450)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = licenses.fit_licenses(frame, "text")
    notices = list(PLANTED.items())
    planted = spark.createDataFrame([(1000 + k, n) for k, (n, _) in enumerate(notices)], frame.schema)
    got = licenses.scan_licenses(frame.unionByName(planted), model, "doc_id", "text").collect()
    assert {(r.id, r.family) for r in got if r.confirmed} == {(1000 + k, f) for k, (_, f) in enumerate(notices)}
    # nothing that the classifier accepts is passed over: without the filter the rows are the same
    whole = licenses.LicenseModel(model.vocabulary, words, model.regression, model.temperature)
    same = licenses.scan_licenses(frame.unionByName(planted), whole, "doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, same))


def test_notices_with_other_words_on_their_line_are_confirmed(spark):
    frame = spark.createDataFrame([(k, f"the tale of river {k} and hill") for k in range(20)], "doc_id long, text string")
    model = licenses.fit_licenses(frame, "text")
    lines = [
        ("Copyright 2024 Acme Corp. All rights reserved.", "reserved"),
        ("Acme tools 2.1, released under the MIT License.", "MIT"),
        ("All the rights of the people were reserved for another day of rain", None),
    ]
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(lines)], "doc_id long, text string")
    got = licenses.scan_licenses(rows, model, "doc_id", "text").collect()
    assert {(r.id, r.family) for r in got if r.confirmed} == {(k, f) for k, (_, f) in enumerate(lines) if f}


def test_other_licences_are_not_given_a_family(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.fit_licenses(docs, "text")
    others = [
        "Licensed under the ISC License.",
        "Licensed under CC BY-SA 4.0.",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Released under the Foo License.",
        "Licensed under the Quux License, version 2.0.",
    ]
    known = [n for ns in licenses.NOTICES.values() for n in ns]
    rows = spark.createDataFrame(list(enumerate([*others, *known])), "doc_id long, text string")
    got = licenses.scan_licenses(rows, model, "doc_id", "text").collect()
    assert not [r for r in got if r.id < len(others)]
    family = {n: f for f, ns in licenses.NOTICES.items() for n in ns}
    assert {r.text: r.family for r in got if r.confirmed} == family


def test_no_line_is_lost_by_passing_over_and_the_regression_is_evaluated_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 3 = 0")
    model = licenses.fit_licenses(docs, "text")
    assert len(model.needed) < len(model.vocabulary) / 2
    notices = [n for ns in licenses.NOTICES.values() for n in ns]
    half = [" ".join(n.split()[: len(n.split()) // 2 + k]) for n in notices for k in (0, 1, 2)]
    lines = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(half)], "doc_id long, text string")
    docs = docs.unionByName(lines)
    plans = []
    kept = licenses.materialize
    monkeypatch.setattr(
        licenses, "materialize",
        lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name),
    )
    got = licenses.scan_licenses(docs, model, "doc_id", "text")
    written = got._jdf.queryExecution().executedPlan().toString()
    # Two evaluations in the plan that writes margins: the vector of n-grams, and the regression.
    assert plans[0].count("UDF(") <= 3 and "UDF(" not in written
    every = docs.selectExpr("doc_id AS id", "posexplode(split(text, '\\n', -1)) AS (paragraph, text)")
    scored = licenses.margins(every, model).collect()
    want = []
    for r in scored:
        top = max(range(len(r.margins)), key=lambda k: (r.margins[k], -k))
        total = sum(math.exp(m - r.margins[top]) for m in r.margins)
        if 1 <= top < len(licenses.FAMILIES) and 1 / total >= licenses.LEAST_PROBABILITY:
            want.append((r.id, r.paragraph, licenses.FAMILIES[top], round(1 / total, 9)))
    found = [(r.id, r.paragraph, r.family, round(r.probability, 9)) for r in got.collect()]
    assert sorted(found) == sorted(want) and len(want) > 20
