"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ``order`` bytes, learnt from sample texts and
then frozen. A byte costs ``-log2(c / (n + q))`` in a context seen ``n`` times with ``q`` different
bytes behind it, ``c`` times this one. Where it was not seen the escape costs ``-log2(q / (n + q))``
and the next shorter context is asked; a context the language has not seen costs nothing. Behind the
empty context all 256 bytes are equally likely. A text's code length is the exact sum over its bytes;
the language of the shortest code is the prediction.

The trees of all languages are one table: a node per byte string seen in any language, with what
each language pays for its last byte (``spent``) and for all escapes from it (``escapes``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm import tokens

#: Longest context in bytes.
ORDER = 4
#: Texts per language that the trees are learnt from, none of more characters than given, and how
#: many times as many are ranked.
TEXTS, MOST_CHARS = 400, 20_000
SPARE = 4
#: Languages at most: their trees are held side by side.
MOST_LANGUAGES = 1000
#: Bytes scored at once; longer texts go window by window.
WINDOW_BYTES = 1 << 19


@dataclass(frozen=True)
class Trees:
    """The frozen trees of ``languages``; node 0 is the empty string (or no node).

    Nodes 1 to 256 are the single bytes, longer strings follow by length. ``follow[node * width +
    kind[byte]]`` is the node with one byte more, 0 if there is none.
    """

    languages: tuple[str, ...]
    order: int
    kind: np.ndarray
    width: int
    follow: np.ndarray
    spent: np.ndarray
    escapes: np.ndarray

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits per text and language, for texts that stand one after the other in ``data``."""
        totals = np.zeros((len(starts), len(self.languages)))
        for at in range(0, len(data), WINDOW_BYTES):
            self._add(data, starts, at, min(at + WINDOW_BYTES, len(data)), totals)
        return totals

    def _add(self, data: np.ndarray, starts: np.ndarray, a: int, b: int, totals: np.ndarray) -> None:
        back = max(0, a - self.order)
        kinds = self.kind[data[back:b]]
        first, last = np.searchsorted(starts, [back, b])
        heads = starts[first:last] - back
        node = data[back:b].astype(np.int32) + 1
        deepest, context = node, node
        for level in range(2, self.order + 2):
            before = np.empty_like(node)
            before[0], before[1:] = 0, node[:-1]
            before[heads] = 0  # a text begins without a context
            node = self.follow[before.astype(np.int64) * self.width + kinds]
            deepest = np.where(node > 0, node, deepest)
            if level <= self.order:
                context = deepest
        before = np.empty_like(context)
        before[0], before[1:] = 0, context[:-1]
        before[heads] = 0
        # Escapes down from the longest context known, up to the one that has the byte.
        bits = self.spent[deepest[a - back :]] + self.escapes[before[a - back :]]
        texts = np.searchsorted(starts, [a, b - 1], "right") - 1
        cuts = np.maximum(starts[texts[0] : texts[1] + 1] - a, 0)
        nonempty = np.diff(np.append(cuts, b - a)) > 0
        sums = np.add.reduceat(bits, cuts[nonempty], axis=0)
        totals[texts[0] : texts[1] + 1][nonempty] += sums


def held_out(key: Column, remainder: int = 1, of: int = 3) -> Column:
    """Whether a document is kept from learning; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of == remainder


def sample_texts(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int = TEXTS, most_chars: int = MOST_CHARS
) -> DataFrame:
    """``(lang, text)``: at most ``texts`` per language, the first by a hash of id and text.

    A hash threshold from the language's number of rows comes first: about ``SPARE`` times as many
    texts pass, so that what is ranked for a language does not grow with the input. The numbers are
    one row per language, of which there may be ``MOST_LANGUAGES``; more stop the job.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    lang = F.col(f"`{lang_col}`")
    learnt = docs.where(~held_out(key) & lang.isNotNull())
    counted = learnt.groupBy(lang.alias("lang")).agg(F.count("*").alias("rows"))
    counts = counted.limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = F.broadcast(docs.sparkSession.createDataFrame(counts, counted.schema))
    usable = learnt.where(text.rlike(r"\p{L}") & (F.length(text) <= most_chars))
    hashed = usable.select(lang.alias("own"), text.alias("text"), F.xxhash64(key, text).alias("h"))
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    passed = F.col("own").eqNullSafe(F.col("lang")) & (share * F.col("rows") <= SPARE * texts)
    some = hashed.join(rows, passed).select("lang", "text", "h")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return some.withColumn("place", place).where(F.col("place") <= texts).select("lang", "text")


def count_strings(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, length, code, n)``: how often every byte string of up to ``order + 1`` bytes occurs.

    A code is the string's bytes as one number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                texts = batch.column("text").filter(pa.array(langs == lang))
                for length in range(1, order + 2):
                    found = [_codes(np.frombuffer(t.as_py().encode(), np.uint8), length) for t in texts]
                    codes, n = np.unique(np.concatenate(found), return_counts=True)
                    columns = [
                        pa.array([lang] * len(codes), pa.string()),
                        pa.array(np.full(len(codes), length, np.int32)),
                        pa.array(codes),
                        pa.array(n),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "length", "code", "n"])

    counted = sample.mapInArrow(count, "lang string, length int, code long, n long")
    return counted.groupBy("lang", "length", "code").agg(F.sum("n").alias("n"))


def _codes(data: np.ndarray, length: int) -> np.ndarray:
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for i in range(length):
        out = out * 256 + data[i : i + n]
    return out


def freeze_trees(counts: pa.Table, order: int = ORDER) -> Trees:
    """The joint table of all languages' trees from ``count_strings``."""
    langs = counts.column("lang").to_numpy(zero_copy_only=False)
    lengths, codes, n = (counts.column(c).to_numpy() for c in ("length", "code", "n"))
    languages = tuple(sorted(set(langs.tolist())))
    place = {lang: i for i, lang in enumerate(languages)}
    which = np.array([place[x] for x in langs], np.int64)
    size = len(languages)
    strings, seen = [np.zeros(1, np.int64)], [np.zeros((1, size))]
    for length in range(1, order + 2):
        own = lengths == length
        found = np.arange(256) if length == 1 else np.unique(codes[own])
        table = np.zeros((len(found), size))
        table[np.searchsorted(found, codes[own]), which[own]] = n[own]
        strings.append(found)
        seen.append(table)
    kinds = np.unique(strings[2] % 256) if order else np.zeros(0, np.int64)
    kind = np.full(256, len(kinds), np.int64)
    kind[kinds] = np.arange(len(kinds))
    width = len(kinds) + 1
    ids = np.cumsum([0, *(len(s) for s in strings)])
    inner = ids[order + 1]  # nodes that can be contexts
    follow = np.zeros(inner * width, np.int32)
    spent, escapes = np.zeros((ids[-1], size)), np.zeros((inner, size))
    cost = np.full((1, size), 8.0)
    for length in range(order + 2):
        if length <= order:  # what an escape from these strings costs
            context = np.searchsorted(strings[length], strings[length + 1] // 256)
            total = np.zeros((len(strings[length]), size))
            kept = total.copy()
            np.add.at(total, context, seen[length + 1])
            np.add.at(kept, context, seen[length + 1] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(kept / (total + kept)), 0.0)
            shorter = strings[length] % 256 ** max(length - 1, 0)
            at = ids[length] + np.arange(len(strings[length]))
            if length:
                below = ids[length - 1] + np.searchsorted(strings[length - 1], shorter)
                escapes[at] = leave + escapes[below]
            else:
                escapes[at] = leave
            # What the last byte of a longer string costs, here or after escaping.
            with np.errstate(divide="ignore", invalid="ignore"):
                here = -np.log2(seen[length + 1] / (total + kept)[context])
            if length:
                tail = np.searchsorted(strings[length], strings[length + 1] % 256**length)
            else:
                tail = np.zeros(256, np.int64)
            longer = np.where(seen[length + 1] > 0, here, leave[context] + cost[tail])
            to = ids[length + 1] + np.arange(len(strings[length + 1]))
            spent[to] = longer - escapes[ids[length] + context]
            if length:
                follow[(ids[length] + context) * width + kind[strings[length + 1] % 256]] = to
            cost = longer
    return Trees(languages, order, kind, width, follow, spent, escapes)


def fit_languages(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    order: int = ORDER,
    texts: int = TEXTS,
    most_chars: int = MOST_CHARS,
) -> Trees | None:
    """Trees of the languages of documents that are not held out; None if there are none.

    The sample is bounded by ``texts`` per language of ``most_chars`` each, and so are the trees.
    """
    counts = count_strings(sample_texts(docs, id_col, text_col, lang_col, texts, most_chars), order)
    table = counts.toArrow()
    return freeze_trees(table, order) if len(table) else None


def predict_languages(trees: Trees | None, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, lang_pred, score)`` of every row.

    ``score`` is the prediction's probability if all languages are equally likely beforehand and
    code lengths are taken as they are. Texts that are NULL or have no letter are ``und`` with score
    0, as is every text if no language was learnt. Of equally short codes the first language by name
    wins.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if trees is None:
        return rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            for first, texts in tokens.text_slices(batch, "text", 1 << 20):
                known = batch.column("letters").slice(first, len(texts)).to_numpy(zero_copy_only=False)
                best, score = _shortest(own.code_lengths(*_flat(texts)))
                best = np.where(known, best, len(names) - 1)
                columns = [
                    batch.column("id").slice(first, len(texts)),
                    pa.array(names[best], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("id", "text", letters).mapInArrow(predict, schema)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; NULL is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets[:-1] - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0]


def _shortest(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = bits.argmin(1)
    more = bits - bits.min(1)[:, None]
    return best, 1.0 / np.exp2(-more).sum(1)


def code_length(trees: Trees, text: str, lang: str) -> float:
    """Bits of one text under one language's tree."""
    data = np.frombuffer(text.encode(), np.uint8)
    return float(trees.code_lengths(data, np.zeros(1, np.int64))[0, trees.languages.index(lang)])


def learnt(trees: Trees | None) -> Sequence[str]:
    return () if trees is None else trees.languages
