"""Sketches against brute force on the same hashes, and estimates against true similarities."""

import hashlib

import xxhash
from pyspark.sql import functions as F

from foldwise.llm import sketches
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def signed(value):
    return value - 2**64 if value >= 2**63 else value


def sketch(text, k=128):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in (text or "").lower().split()]
    if not words:
        return []
    out = set()
    for i in range(max(1, len(words) - 4)):
        seed = 42
        for value in words[i : i + 5]:
            seed = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed)
        out.add(signed(seed))
    return sorted(out)[:k]


def resemblance(a, b, k=128):
    least = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in least) / len(least) if least else 1.0


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_bottom_k_sketch"](spark, SF).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert len(rows) == len(docs)
    for k, (doc, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other = sketch(text), sketch(edited)
        assert r.fingerprint == "".join(f"{h % 2**64:016x}" for h in own)
        assert r.edited_fingerprint == "".join(f"{h % 2**64:016x}" for h in other)
        assert r.near_edited == resemblance(own, other)
        assert r.near_next == resemblance(own, sketch(following))


def test_order_of_hard_rows_and_single_rows(spark, hard, empty):
    rows = sketches.compare_with_edits(hard, "doc_id", "text").collect()
    assert len(rows) == hard.count()
    nexts = {r.id: r.edited for r in rows}
    assert nexts[0] == "A plain text of some te" + "A plain text of some t"
    one = sketches.with_next(hard.where("doc_id = 7"), "doc_id", "text").collect()
    assert [(r.id, r.next_text) for r in one] == [(7, "x")]
    assert sketches.compare_with_edits(empty, "doc_id", "text").collect() == []


def test_estimates_and_merging(spark):
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 2000), (1000, 3000), (0, 1000), (0, 30))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    made = sketches.with_sketch(frame, "text", "s", k=512)
    s = {r.id: r.s for r in made.collect()}
    pair = spark.createDataFrame([tuple(s[i] for i in range(4))], "a array<long>, b array<long>, c array<long>, d array<long>")
    a, b, c, d = (F.col(x) for x in "abcd")
    r = pair.select(
        sketches.resemblance(a, b, 512).alias("ab"),
        sketches.containment(c, a, 512).alias("ca"),
        sketches.containment(a, c, 512).alias("ac"),
        sketches.distinct_shingles(a, 512).alias("na"),
        sketches.distinct_shingles(d, 512).alias("nd"),
        sketches.merged(a, b, 512).alias("m"),
        sketches.resemblance(F.array().cast("array<long>"), F.array().cast("array<long>")).alias("none"),
    ).first()
    assert abs(r.ab - 1 / 3) < 0.08 and r.ca > 0.9 and abs(r.ac - 0.5) < 0.08
    assert abs(r.na / 1996 - 1) < 0.15 and r.nd == 26 and r.none == 1.0
    whole = sketches.with_sketch(frame.limit(2).groupBy().agg(F.lit(" ".join(f"w{i}" for i in range(3000))).alias("text")), "text", "s", k=512)
    assert r.m == whole.first().s
    merged = sketches.merge_groups(made.where("id < 2").withColumn("g", F.lit(1)), ["g"], "s", k=512)
    assert merged.first().s == r.m
