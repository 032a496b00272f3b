"""Passages that repeat across documents: paragraphs by MinHash bands, and stretches inside them.

* Paragraphs are lines, of any number of words. All distinct ones are banded by MinHash over their
  whole sets of 5-word shingles (a shorter line is one shingle); those that meet in a band are verified
  by exact Jaccard and joined to components.
* A passage may stand inside a longer line, or across lines: stretches of 20 words begin at places
  that their own words choose, the least 5-word run of any 21, so every run of 40 words or more that
  documents share holds a stretch that is the same in all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.components import connected_components
from foldwise.workspace import materialize

SHINGLE = 5
WORDS = 20
SPREAD = 21
SIMILARITY = 0.8
ROWS = 3
RECALL = 0.98
#: Paragraphs, and words of them, in one piece of the verification.
TILE_ROWS = 512
TILE_WORDS = 1 << 18
_STEP = np.uint64(0x100000001B3)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """Fewest bands of ``rows`` values that pairs of the similarity collide in with the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = values + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def _runs(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` values."""
    width = len(values) - length + 1
    with np.errstate(over="ignore"):
        total = np.zeros(width, np.uint64)
        for k in range(length):
            total = total * _STEP + values[k : k + width]
    return _mixed(total)


class _Hashes(dict):
    """64-bit hashes of lower-cased words, remembered for a bounded number of them."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        if len(self) < 400_000:
            self[word] = value
        return value


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the least value in any ``width`` consecutive ones."""
    width = min(width, len(values))
    views = np.lib.stride_tricks.sliding_window_view(values, width)
    found = []
    for at in range(0, len(views), 65536):  # parts bound the memory of a very long text
        part = views[at : at + 65536]
        found.append(np.unique(part.argmin(axis=1) + np.arange(at, at + len(part))))
    return np.unique(np.concatenate(found))


def _content(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def _shingles(own: np.ndarray) -> np.ndarray:
    """Shingle hashes of a paragraph's hashed words; fewer words than a shingle are one."""
    return _runs(own, min(SHINGLE, len(own)))


def band_keys(own: np.ndarray, edges: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """``(paragraph, band)`` MinHash band keys of the paragraphs ``edges[k] : edges[k + 1]``."""
    starts, sizes = edges[:-1], np.diff(edges)
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    first = np.cumsum(counts) - counts
    runs = _runs(own, SHINGLE) if len(own) >= SHINGLE else np.zeros(1, np.uint64)
    place = np.repeat(starts - first, counts) + np.arange(counts.sum())
    shingles = runs[np.minimum(place, len(runs) - 1)]
    for k in np.flatnonzero(sizes < SHINGLE).tolist():
        shingles[first[k]] = _shingles(own[starts[k] : starts[k] + sizes[k]])[0]
    number = np.arange(rows * bands, dtype=np.uint64)
    factors, shifts = _mixed(number, 1) | np.uint64(1), _mixed(number, 2)  # shingles are mixed already
    least = np.full((rows * bands, len(sizes)), _MOST)
    for at in range(0, len(sizes), 4096):  # parts bound the memory of a very long text
        low = first[at]
        high = first[at + 4096] if at + 4096 < len(sizes) else len(shingles)
        own_firsts = first[at : at + 4096] - low
        for k in range(rows * bands):
            least[k, at : at + 4096] = np.minimum.reduceat(shingles[low:high] * factors[k] + shifts[k], own_firsts)
    table = least.reshape(bands, rows, len(sizes))
    keys = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(sizes), axis=1)
    for row in range(rows):
        keys = _mixed(keys ^ table[:, row])
    return np.ascontiguousarray(keys.T)


def stretches_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the stretches of a text's hashed words; none below 20 words."""
    if len(own) < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = _least(_runs(own, SHINGLE)[: len(own) - WORDS + 1], SPREAD)
    return starts, _runs(own, WORDS)[starts]


def units_of(text: str | None, hashes: dict[str, int], rows: int, bands: int) -> tuple:
    """Starts, lengths, hashes and bands of a text's lines, then of its stretches, whose bands are None."""
    lines = [words for words in (line.split() for line in (text or "").split("\n")) if words]
    sizes = np.array([len(words) for words in lines], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not lines:
        return edges[:0], sizes, np.zeros(0, np.uint64), []
    own = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lines)), np.uint64, int(edges[-1]))
    content = [_content(own[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    keys = [key.tobytes() for key in band_keys(own, edges, rows, bands)]
    starts, stretches = stretches_of(own)
    return (
        np.concatenate([edges[:-1], starts]),
        np.concatenate([sizes, np.full(len(starts), WORDS)]),
        np.concatenate([np.array(content, np.uint64), stretches]),
        keys + [None] * len(starts),
    )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, doc, row, text)``: ``doc`` and ``row`` stand for the id and for the id with its text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    document = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.xxhash64("id"))
    return rows.select("id", document.alias("doc"), F.xxhash64(document, "text").alias("row"), "text")


def _each(rows: DataFrame, schema: T.StructType, carried: list[str], make, inputs: list[str]) -> DataFrame:
    """``make`` gives a row's columns as arrays of one length; ``carried`` columns are repeated."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                given = zip(*[part.column(c).to_pylist() for c in inputs], strict=True)
                made = [make(hashes, *values) for values in given]
                many = [len(m[0]) for m in made]
                if not sum(many):
                    continue
                take = pa.array(np.repeat(np.arange(len(many)), many))
                columns = [part.column(c).take(take) for c in carried]
                for k, field in enumerate(schema.fields[len(carried) :]):
                    values = [m[k] for m in made]
                    if isinstance(field.dataType, T.BinaryType):
                        columns.append(pa.array([x for v in values for x in v], pa.binary()))
                        continue
                    joined = np.concatenate([v for v in values if len(v)])
                    short = isinstance(field.dataType, T.IntegerType)
                    columns.append(pa.array(joined.astype(np.int32) if short else joined.view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(build, schema)


def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


def _units(texts: DataFrame, rows: int, bands: int) -> DataFrame:
    schema = _fields(
        ("id", texts.schema["id"].dataType), ("doc", T.LongType()), ("row", T.LongType()),
        ("start", T.IntegerType()), ("n_words", T.IntegerType()), ("content", T.LongType()),
        ("bands", T.BinaryType()),
    )
    make = lambda hashes, text: units_of(text, hashes, rows, bands)
    return _each(texts, schema, ["id", "doc", "row"], make, ["text"])


def _words(places: DataFrame) -> DataFrame:
    """``(content, words)``: the 64-bit word hashes of the paragraphs at ``starts`` of ``text``."""
    schema = _fields(("content", T.LongType()), ("words", T.BinaryType()))

    def make(hashes: dict[str, int], text: str, lines: list[dict]) -> tuple:
        words = text.split()
        found = [words[x["start"] : x["start"] + x["n_words"]] for x in lines]
        own = [np.fromiter(map(hashes.__getitem__, x), np.uint64, len(x)) for x in found]
        return np.array([_content(x) for x in own], np.uint64), [x.tobytes() for x in own]

    return _each(places, schema, [], make, ["text", "lines"])


def jaccard_links(content: np.ndarray, table: Sequence[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the paragraphs whose shingles are similar enough, verified exactly."""
    content, first = np.unique(content, return_index=True)
    sets = [frozenset(table[k].tolist()) for k in first]
    holders: dict[int, set[int]] = {}
    for k, own in enumerate(sets):
        for shingle in own:
            holders.setdefault(shingle, set()).add(k)
    left, links = set(range(len(sets))), []

    def take(k: int) -> int:
        """Leave ``k`` out of the holders: what is connected is never looked at again."""
        left.discard(k)
        for shingle in sets[k]:
            holders[shingle].discard(k)
        return k

    while left:
        frontier = [take(next(iter(left)))]
        while frontier and left:
            one = frontier.pop()
            shared: dict[int, int] = {}
            for shingle in sets[one]:
                for k in holders[shingle]:
                    shared[k] = shared.get(k, 0) + 1
            for k, n in shared.items():
                if n >= similarity * (len(sets[one]) + len(sets[k]) - n):
                    frontier.append(take(k))
                    links.append((int(content[one]), int(content[k])))
    return links


def _near_links(lines: DataFrame, texts: DataFrame, similarity: float, bands: int) -> DataFrame:
    """``(src, dst)`` links that connect the distinct lines which meet in a band and are similar.

    Bands that hold the same lines are one. A band of many lines is cut into tiles, and each pair
    of tiles is a piece of work of its own, so that no band is too long for a task.
    """
    keys = F.array(*[F.xxhash64(F.substring("bands", 1 + 8 * k, 8)) for k in range(bands)])
    banded = lines.select(F.explode(keys).alias("band"), "content", "n_words")
    shared = banded.groupBy("band").agg(
        F.count("*").alias("n"),
        F.sum(F.col("n_words").cast("long")).alias("size"),
        F.bit_xor("content").alias("all"),
        F.min("content").alias("least"),
        F.max("content").alias("most"),
    )
    shared = shared.where("n > 1").groupBy("n", "size", "all", "least", "most").agg(F.min("band").alias("band"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("size") / TILE_WORDS)).cast("int")
    shared = materialize(shared.select("band", tiles.alias("tiles")), "shared-bands")
    met = materialize(banded.join(shared, "band").select("band", "tiles", "content"), "met")
    places = lines.join(met.select("content").distinct(), "content").groupBy("place.row").agg(
        F.collect_list(F.struct("place.start", "n_words")).alias("lines")
    )
    words = _words(texts.select("row", "text").join(places, "row").select("text", "lines"))
    words = words.groupBy("content").agg(F.first("words").alias("words"))
    pieces = (
        met.join(words, "content")
        .withColumn("own", F.pmod(F.xxhash64("content"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .groupBy("band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        .agg(F.collect_list("content").alias("contents"), F.collect_list("words").alias("words"))
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for content, words in zip(batch["contents"], batch["words"], strict=True):
                table = [_shingles(np.frombuffer(x, np.uint64)) for x in words]
                found.update(jaccard_links(np.asarray(content, np.int64), table, similarity))
            yield pd.DataFrame(sorted(found), columns=["src", "dst"], dtype="int64")

    return pieces.select("contents", "words").mapInPandas(link, "src long, dst long").distinct()


def _line_classes(lines: DataFrame, texts: DataFrame, similarity: float, bands: int) -> DataFrame:
    """``(content, class_id, first, n)`` of the lines whose class stands in several documents."""
    distinct = lines.groupBy("content").agg(
        F.first("bands").alias("bands"),
        F.first("n_words").alias("n_words"),
        F.min(F.struct("row", "start")).alias("place"),
        F.min(F.struct("id", "start")).alias("first"),
        F.min("doc").alias("lo"),
        F.max("doc").alias("hi"),
        F.count("*").alias("n"),
    )
    distinct = materialize(distinct, "lines")
    found = connected_components(_near_links(distinct, texts, similarity, bands))
    each = distinct.join(found, distinct.content == found.node, "left").select(
        "content", F.coalesce("component", "content").alias("class_id"), "first", "lo", "hi", "n"
    )
    classes = each.groupBy("class_id").agg(
        F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")
    )
    return each.select("content", "class_id").join(
        classes.where("lo < hi").select("class_id", "first", "n"), "class_id"
    )


def _stretch_classes(stretches: DataFrame) -> DataFrame:
    """``(content, class_id, first, n)`` of the stretches that several documents hold."""
    crowded = stretches.groupBy("content").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    crowded = materialize(crowded.where("lo < hi").select("content"), "crowded")
    held = stretches.join(crowded, "content")
    return held.groupBy("content").agg(
        F.col("content").alias("class_id"), F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")
    )


def repeated_passages(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    similarity: float = SIMILARITY,
    rows: int = ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """Every line and every stretch of 20 words that documents share:
    ``(id, start, n_words, kind, class_id, n_links, keep)``.

    ``start`` counts white-space separated words. Of kind ``line`` is each paragraph of a class of
    lines that are connected by a Jaccard of ``similarity`` or more, found with ``recall``; equal
    lines are always found, lines under five words only as equal ones. Of kind ``stretch`` are the
    20-word stretches that are equal in several documents; every shared run of 40 words or more has
    one, whatever its lines. Letter case does not matter. ``n_links`` is the number of other members
    of the class, and ``keep`` is true for the first by id and start, the one that stays.

    Classes within one document only are no repeats. Rows with NULL ids count as one document, as
    do rows of one id. NULL, empty and blank texts have no passage. Other columns are not read.
    """
    bands = bands_for(similarity, rows, recall)
    texts = _rows(docs, id_col, text_col)
    units = materialize(_units(texts, rows, bands), "units")
    parts = []
    for kind, own in (("line", units.where("bands is not null")), ("stretch", units.where("bands is null"))):
        classes = _line_classes(own, texts, similarity, bands) if kind == "line" else _stretch_classes(own)
        # Written, so that the join below is of two plain exchanges, which Spark can split by size.
        classes = materialize(classes, f"{kind}-classes")
        placed = own.select("id", "start", "n_words", "content").join(classes, "content")
        parts.append(
            placed.select(
                "id",
                "start",
                "n_words",
                F.lit(kind).alias("kind"),
                "class_id",
                (F.col("n") - 1).alias("n_links"),
                F.struct("id", "start").eqNullSafe(F.col("first")).alias("keep"),
            )
        )
    return parts[0].unionByName(parts[1])
