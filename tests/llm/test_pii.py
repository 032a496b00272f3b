"""Base spans against the plain patterns, and what the method adds."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from foldwise.llm import pii
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_hand(text):
    return ",".join(
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m[0])
    )


def spans(frame, model):
    found = pii.find_pii(frame, model, "text")
    return found.select(
        "text", pii.joined_spans(F.col("base")).alias("base"), pii.joined_spans(F.col("spans")).alias("all")
    ).collect()


def test_base_spans_equal_the_plain_patterns(spark, hard):
    rng = random.Random(3)
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(70))) for a in ("a1@.+- ()5é", "1234 -.") for _ in range(400)]
    texts += [
        "a@b.c_d@e.f x@y.z@q.r", "1.2.3.4.5.6.7.8 300.1.2.3.4 01.002.3.4", "9" * 5000 + "@" + "y" * 3000,
        "4111 1111 1111 1111-2 x4111-1111-1111-1111.", "1.1.1.1" * 50, "+1((((....1 +1 2 +123456789", "1-" * 2000,
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = pii.fit_pii(frame, "text")
    assert all(r.base == by_hand(r.text) for r in spans(frame, model))
    assert all(r.base == by_hand(r.text) for r in spans(hard, model))


def test_query_counts_and_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op7_weak_supervision_pii"](spark, SF).collect():
        want = by_hand(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        kinds = [s.split(":")[0] for s in want.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in PLAIN]
        assert set(want.split(",")) <= set(r.spans.split(","))


def test_labelers_that_agree_are_trusted_and_add_spans(spark):
    texts = [f"my mail is user{i}@example.com" for i in range(30)]
    texts += [f"contact mail: person{i} (at) example (dot) com" for i in range(10)]
    texts += [f"order number 4111 1111 1111 {1000 + i}" for i in range(30)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = pii.fit_pii(frame, "text")
    assert all(0.5 < a < 1 for own in model.reliabilities.values() for a in own.values())
    found = {r.text: r for r in spans(frame, model)}
    added = found["contact mail: person3 (at) example (dot) com"]
    assert added.base == "" and added.all == "email:14:44"
    assert not any(r["all"] != r.base for t, r in found.items() if t.startswith("order"))


def test_redaction_and_empty_tables(hard, empty):
    model = pii.fit_pii(hard, "text")
    rows = pii.find_pii(hard, model, "text")
    clean = rows.select("row.doc_id", "row.id", "text", pii.redact(F.col("text"), F.col("spans")).alias("c"))
    for r in clean.collect():
        if r.doc_id is None and r.text:
            assert r.c == "no id at all, but mail <email> and <phone>"
        else:
            assert r.c == r.text
        assert r.id == "clash"
    assert pii.find_pii(empty, pii.fit_pii(empty, "text"), "text").collect() == []
