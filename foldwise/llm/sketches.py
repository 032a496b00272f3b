"""Bottom-k sketches of word shingles: mergeable, and they tell resemblance and containment.

A sketch is the sorted array of the ``k`` least 64-bit hashes of a text's distinct shingles; with
fewer shingles it is all of them and its estimates are exact.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5


def with_sketch(rows: DataFrame, text_col: str, out_col: str, k: int = K, n_words: int = WORDS) -> DataFrame:
    """``rows`` with the sketch of a text column.

    Words are cut at ASCII white space and lowered. Fewer words than ``n_words`` make one shingle;
    NULL, empty and blank texts have the empty sketch. Columns that start with ``_w_`` must be free.
    """
    words = F.split(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), r"[\x20\x09-\x0D]+")
    hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = rows.withColumn("_w_hashes", hashed)
    own = F.col("_w_hashes")

    def shingle(i: Column) -> Column:
        return F.xxhash64(*[F.get(own, i + j) for j in range(n_words)])

    size = F.size(own)
    shingles = F.when(
        size >= n_words, F.transform(F.sequence(F.lit(0), size - n_words), shingle)
    ).when(size > 0, F.array(F.xxhash64(own)))
    sketch = F.slice(F.array_sort(F.array_distinct(shingles)), 1, k)
    empty = F.array().cast("array<bigint>")
    return rows.withColumn(out_col, F.coalesce(sketch, empty)).drop("_w_hashes")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of both texts' shingles together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sketches resemble each other fully."""
    least = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) == 0, 1.0).otherwise(both / F.size(least))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    top = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 for an empty ``a``."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    share = F.least(F.lit(1.0), shared / distinct_shingles(a, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(share)


def merge_groups(rows: DataFrame, by: list[str], sketch_col: str, k: int = K, parts: int = 64) -> DataFrame:
    """One sketch per group, merged in ``parts`` parts first, so that no group is one task's work."""
    hashes = rows.select(*by, F.explode(sketch_col).alias("_hash")).distinct()

    def least(frame: DataFrame, keys: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
        return frame.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")

    spread = hashes.withColumn("_part", F.pmod("_hash", F.lit(parts)))
    few = least(least(spread, [*by, "_part"]).drop("_part"), by)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list("_hash")).alias(sketch_col))


def sketch_text(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _blocks(spark: SparkSession, keys: DataFrame, count: int) -> list[int]:
    """Cut points that part the ordered keys into about equal blocks; ``count`` of them at most."""
    shares = [i / count for i in range(1, count)] or [0.5]
    cuts = keys.agg(F.percentile_approx("key", shares, 20 * count).alias("cuts")).first().cuts
    return sorted(set(cuts or []))


def _block_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are not above the key; found among every n-th cut, then among n."""
    if not cuts:
        return F.lit(0)
    wide = max(1, int(len(cuts) ** 0.5))
    every = F.array(*[F.lit(c) for c in cuts[::wide]])
    coarse = F.size(F.filter(every, lambda c: c <= key))
    known = F.array(*[F.lit(c) for c in cuts])
    first = F.greatest(coarse - 1, F.lit(0)) * wide
    fine = F.size(F.filter(F.slice(known, first + 1, F.lit(wide)), lambda c: c <= key))
    return first + fine


def with_next(docs: DataFrame, id_col: str, text_col: str, k: int = K, n_words: int = WORDS) -> DataFrame:
    """``(id, text, sketch, next_text, next_sketch)``: each document and the next by ascending id.

    The last is followed by the first; NULL ids come first; repeated ids are ordered by their texts.
    Documents are dealt to blocks of neighbouring ids, a few per shuffle partition, and the first of
    each block is also sent, as a guest, to the block before.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", key)
    cuts = _blocks(spark, rows.select("key"), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = _block_of(F.col("key"), cuts)
    heads = rows.groupBy(block.alias("block")).agg(F.min("key").alias("head"))
    found = sorted((r.block, r.head) for r in heads.collect())  # one row per block
    before = {head: found[i - 1][0] for i, (_, head) in enumerate(found)}
    guests = F.lit(None).cast("int")
    if before:
        pairs = [F.lit(x) for head, own in sorted(before.items()) for x in (head, own)]
        guests = F.when(
            F.array_contains(F.array(*[F.lit(h) for h in sorted(before)]), F.col("key")),
            F.element_at(F.create_map(*pairs), F.col("key")),
        )
    homes = F.array_compact(
        F.array(
            F.struct(block.alias("block"), F.lit(0).alias("guest")),
            F.when(guests.isNotNull(), F.struct(guests.alias("block"), F.lit(1).alias("guest"))),
        )
    )
    dealt = rows.withColumn("home", F.explode(homes)).select("id", "text", "key", "home.*")
    here = with_sketch(dealt.repartition("block"), "text", "sketch", k, n_words)
    order = Window.partitionBy("block").orderBy("guest", "key", "text")
    following = F.lead(F.struct("text", "sketch")).over(order)
    return here.withColumn("next", following).where("guest = 0").select(
        "id",
        "text",
        "sketch",
        F.col("next.text").alias("next_text"),
        F.col("next.sketch").alias("next_sketch"),
    )


def compare_with_edits(docs: DataFrame, id_col: str, text_col: str, k: int = K, n_words: int = WORDS) -> DataFrame:
    """Every document against its edited text and against the next document.

    The edited text has the last ``floor(n / 2)`` code points replaced by the first as many (or all)
    of the next document. ``(id, text, sketch, edited, edited_sketch, near_edited, near_next)``.
    """
    rows = with_next(docs, id_col, text_col, k, n_words)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    rows = with_sketch(rows.withColumn("edited", edited).drop("next_text"), "edited", "edited_sketch", k, n_words)
    return rows.withColumns(
        {
            "near_edited": resemblance(F.col("sketch"), F.col("edited_sketch"), k),
            "near_next": resemblance(F.col("sketch"), F.col("next_sketch"), k),
        }
    ).drop("next_sketch")


