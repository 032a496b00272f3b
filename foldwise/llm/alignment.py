"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Byte offsets at which tokens of both sides end cut a text into groups. A byte range of a text is a
fragment: the tokens up to its first common end (open prefix), the groups between common ends
(closed), and the tokens behind the last one (open suffix). Fragments compose associatively, so a
very long text is cut into byte ranges that are tokenized in different tasks, and a tree of
compositions closes the groups at the seams. A short text is one fragment.

How often an id pair is linked corpus-wide is counted over blocks of documents: a block lists its
distinct pairs once, the counts are joined to these lists and go back to the block's documents.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm import tokens
from foldwise.workspace import materialize

#: Bytes of a range; texts of more are cut.
CHUNK_BYTES = 32_768
#: Fragments composed by one task of the tree.
FAN = 16
#: Distinct words a worker remembers for the second tokenizer.
REMEMBERED = 120_000
#: Links written out at once.
MOST_LINKS = 1_000_000
#: Links of a group from which its equal ids are put together first.
WIDE = 64
#: Bytes of text aligned at once.
SLICE_BYTES = 1 << 20
#: Words around a cut, so that neither tokenizer has a token across it.
_SAFE_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")

_CHUNK = "uid long, k int, chunks int, base long, low long, high long, segment binary"
_OPEN = "has boolean, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>"
#: ``k`` numbers the fragments of one level of the tree; ``place`` is the range where one begins.
_PART = (
    f"uid long, k int, place int, seam boolean, {_OPEN}, same boolean, n_a long, n_b long, "
    "n_groups long, n_links long, groups binary, codes array<long>, times array<long>"
)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


_CLOSED = "uid place seam same n_a n_b n_groups n_links groups codes times".split()


class PieceEncoder:
    """Ids of texts by a sentencepiece model, remembered per space-separated word.

    No piece of the model holds a space behind another character (otherwise texts are encoded
    whole), so no token reaches across a single space, and a word's ids don't depend on its place.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.by_word = not any("▁" in name.lstrip("▁") for name in names)
        self.opens = np.array([name.startswith("▁") for name in names])
        self.bytes = [self._bytes_of(i, name) for i, name in enumerate(names)]
        self._forget()

    def _bytes_of(self, i: int, name: str) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(name[3:5], 16)])
        return name.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts, self.sizes, self.flat = tokens._Grown(), tokens._Grown(), tokens._Grown()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.model.encode(" ".join(some), num_threads=1), np.int64)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(some):  # does not come about where pieces keep to words
                own = [self.model.encode(word) for word in some]
                ids = np.array([i for one in own for i in one], np.int64)
                cuts = np.cumsum([0, *map(len, own[:-1])])
            first = len(self.sizes)
            self.starts.extend(len(self.flat) + cuts)
            self.sizes.extend(np.diff(np.append(cuts, len(ids))))
            self.flat.extend(ids)
            self.codes.update(zip(some, range(first, first + len(some)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        plain = pc.invert(pc.match_substring_regex(texts, r"^ |  | $|\x{2581}"))
        if not self.by_word:
            plain = pa.array(np.zeros(len(texts), bool))
        parts = pc.split_pattern(pc.if_else(plain, texts, pa.scalar("", texts.type)), " ")
        bounds = np.asarray(parts.offsets)
        distinct = parts.values[bounds[0] : bounds[-1]].dictionary_encode()
        words = tokens._strings(distinct.dictionary)
        new = [word for word in words if word and word not in self.codes]
        if new:
            self._learn(new)
        codes = np.fromiter((self.codes[w] if w else -1 for w in words), np.int64, len(words))
        codes = codes[distinct.indices.to_numpy(zero_copy_only=False)]
        filled = codes >= 0
        sizes = np.zeros(len(codes), np.int64)
        sizes[filled] = self.sizes.values[codes[filled]]
        starts = np.where(filled, self.starts.values[codes], 0)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat.values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        edges = np.concatenate([[0], ends])[bounds - bounds[0]]
        whole = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if not len(whole):
            return ids, np.diff(edges)
        own = np.split(ids, edges[1:-1]) if len(texts) > 1 else [ids]
        for at in whole:
            own[at] = np.array(self.model.encode(texts[int(at)].as_py(), num_threads=1), np.int64)
        return np.concatenate(own), np.array([len(x) for x in own])


class Side:
    """One tokenizer's bytes per id."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries = pa.array(entries, pa.large_binary())
        self.lengths = np.array([len(x) for x in entries], np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return _data(self.entries.take(pa.array(ids)))


def _data(strings: pa.Array) -> np.ndarray:
    """The bytes of an array of strings, one after the other."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset :][: len(strings) + 1]
    if strings.buffers()[2] is None or not len(strings):
        return np.zeros(0, np.uint8)
    return np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


class Aligner:
    """Both tokenizers in a worker, and what is computed from their tokens."""

    def __init__(self, definition: str, model: bytes) -> None:
        self.first = tokens.Encoder(definition, "spaces")
        self.second = PieceEncoder(model)
        entries = tokens.byte_level_entries(definition)
        size = len(entries)
        self.a, self.b = Side(entries), Side(self.second.bytes)
        self.size_b = self.second.size
        most = max(size, self.size_b)
        # What stands behind an id: nothing, more of its side, the other side, the next group.
        shown = [f"{i}{mark}".encode() for i in range(most) for mark in ("", ",", "|", ";")]
        self.shown = pa.array(shown, pa.large_binary())
        self.shown_lengths = np.array([len(x) for x in shown], np.int64)

    def tokenize(self, segments: pa.Array) -> Tokens:
        """Tokens of segments, each of which begins with a space at which tokens begin."""
        ids_a = self.first.encode(segments)
        n_a = np.array([len(x) for x in ids_a], np.int64)
        ids_a = np.concatenate([*ids_a, np.zeros(0, np.int64)]).astype(np.int64)
        ids_b, n_b = self.second.encode(pc.utf8_slice_codeunits(segments, 1))
        sizes = pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
        same = self._same(segments, sizes, ids_a, n_a, self.a)
        same &= self._same(segments, sizes, ids_b, n_b, self.b)
        if not same.all():
            ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
            n_a, n_b, sizes = n_a * same, n_b * same, sizes * same
        return Tokens(self, ids_a, n_a, ids_b, n_b, sizes, same)

    @staticmethod
    def _same(segments, sizes, ids, counts, side) -> np.ndarray:
        want, have = _data(segments), side.joined(ids)
        if len(want) == len(have) and np.array_equal(want, have):
            lengths = np.add.reduceat(np.append(side.lengths[ids], 0), _starts(counts)) * (counts > 0)
            if np.array_equal(lengths, sizes):
                return np.ones(len(sizes), bool)
        ends = np.concatenate([[0], np.cumsum(side.lengths[ids])])
        edges = ends[np.concatenate([[0], np.cumsum(counts)])]
        places = np.concatenate([[0], np.cumsum(sizes)])
        return np.array(
            [
                np.array_equal(want[places[i] : places[i + 1]], have[edges[i] : edges[i + 1]])
                for i in range(len(sizes))
            ],
            bool,
        )


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


class Tokens:
    """Tokens of both sides of some segments, by where they end."""

    def __init__(self, own: Aligner, ids_a, n_a, ids_b, n_b, sizes, same) -> None:
        self.own, self.same, self.sizes = own, same, sizes
        self.base = _starts(sizes)
        self.rows = len(sizes)
        self.ids_a, self.ids_b = ids_a, ids_b
        self.end_a, self.end_b = np.cumsum(own.a.lengths[ids_a]), np.cumsum(own.b.lengths[ids_b])
        self.row_a = np.repeat(np.arange(self.rows), n_a)
        self.row_b = np.repeat(np.arange(self.rows), n_b)

    def within(self, low: np.ndarray, high: np.ndarray) -> None:
        """Keep the tokens that end behind ``low`` and up to ``high``, counted from the segment."""
        for side in "ab":
            ids, end, row = (getattr(self, f"{x}_{side}") for x in ("ids", "end", "row"))
            place = end - self.base[row]
            kept = (place > low[row]) & (place <= high[row])
            for name, values in (("ids", ids), ("end", end), ("row", row)):
                setattr(self, f"{name}_{side}", values[kept])

    def common_ends(self) -> np.ndarray:
        """Which offsets tokens of both sides end at."""
        marks = np.zeros(int(self.sizes.sum()) + 1, bool)
        common = marks.copy()
        marks[self.end_a] = True
        common[self.end_b] = marks[self.end_b]
        return common

    def open_ends(self, common: np.ndarray) -> list[tuple]:
        """``(has, prefix_a, prefix_b, suffix_a, suffix_b)`` per row; those tokens are taken out."""
        common = np.flatnonzero(common)
        edges = np.searchsorted(common, np.append(self.base, self.sizes.sum()), "right")
        rows, keep_a, keep_b = [], np.ones(len(self.ids_a), bool), np.ones(len(self.ids_b), bool)
        for r in range(self.rows):
            ends = common[edges[r] : edges[r + 1]]
            found: list = [len(ends) > 0]
            for which in ("prefix", "suffix"):
                for ids, end, row, keep in (
                    (self.ids_a, self.end_a, self.row_a, keep_a),
                    (self.ids_b, self.end_b, self.row_b, keep_b),
                ):
                    a, b = np.searchsorted(row, [r, r + 1])
                    if not len(ends):
                        part = slice(a, b) if which == "prefix" else slice(b, b)
                    elif which == "prefix":
                        part = slice(a, a + np.searchsorted(end[a:b], ends[0], "right"))
                    else:
                        part = slice(a + np.searchsorted(end[a:b], ends[-1], "right"), b)
                    keep[part] = False
                    found.append(ids[part].astype(np.int32))
            rows.append(tuple(found))
        self.ids_a, self.end_a, self.row_a = self.ids_a[keep_a], self.end_a[keep_a], self.row_a[keep_a]
        self.ids_b, self.end_b, self.row_b = self.ids_b[keep_b], self.end_b[keep_b], self.row_b[keep_b]
        return rows

    def closed(self, common: np.ndarray) -> Closed:
        """The groups between common ends."""
        before = np.cumsum(common, dtype=np.int32) - common
        group_a, group_b = before[self.end_a], before[self.end_b]
        return closed_groups(
            self.own, self.rows, self.ids_a, group_a, self.row_a, self.ids_b, group_b, self.row_b
        )


class Closed:
    """Per row: how many tokens, groups and links, the groups as text, and the linked pairs."""

    def __init__(self, **parts) -> None:
        self.__dict__.update(parts)


def closed_groups(own: Aligner, rows: int, ids_a, group_a, row_a, ids_b, group_b, row_b) -> Closed:
    """Of tokens with their group and row, in order; a group has tokens of both sides."""
    used = np.bincount(group_a) > 0
    number = np.cumsum(used) - 1
    group_a, group_b = number[group_a], number[group_b]
    n = int(used.sum())
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    row_of = np.zeros(n, np.int64)
    row_of[group_a] = row_a
    n_links = np.zeros(rows, np.int64)
    np.add.at(n_links, row_of, in_a * in_b)
    # The groups as text: the first side's ids, then the second's, group by group.
    through_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[through_a - 1] = True
    last_b[np.cumsum(in_b) - 1] = True
    final = np.append(np.diff(row_of) > 0, [True] * (n > 0))
    shown = np.zeros(len(ids_a) + len(ids_b), np.int64)
    shown[np.arange(len(ids_a)) + before_b[group_a]] = ids_a * 4 + np.where(last_a, 2, 1)
    mark_b = np.where(last_b, np.where(final[group_b], 0, 3), 1)
    shown[np.arange(len(ids_b)) + through_a[group_b]] = ids_b * 4 + mark_b
    n_a, n_b = np.bincount(row_a, minlength=rows), np.bincount(row_b, minlength=rows)
    ends = np.concatenate([[0], np.cumsum(own.shown_lengths[shown])])
    edges = ends[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    data = memoryview(_data(own.shown.take(pa.array(shown))))
    texts = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    keys, times = _linked_pairs(own.size_b, len(own.a.lengths), ids_a, group_a, ids_b, group_b, row_of)
    space = own.size_b * len(own.a.lengths)
    row, codes = np.divmod(keys, space)
    return Closed(
        n_a=n_a,
        n_b=n_b,
        n_groups=np.bincount(row_of, minlength=rows),
        n_links=n_links,
        texts=texts,
        codes=codes,
        times=times,
        pairs=np.bincount(row, minlength=rows),
    )


def _linked_pairs(size_b, size_a, ids_a, group_a, ids_b, group_b, row_of) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``row, a, b`` as one number each, and how often each pair is linked there.

    In groups of many links equal ids are one entry with their number, so that such a group costs
    the product of its distinct ids only; links are written out ``MOST_LINKS`` at a time.
    """
    n = len(row_of)
    links = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n)
    wide = links > WIDE
    if not wide.any():
        return _written_out(size_b, size_a, ids_a, group_a, None, ids_b, group_b, None, row_of)
    in_a, in_b = wide[group_a], wide[group_b]
    entry_a, many_a = np.unique(group_a[in_a].astype(np.int64) * size_a + ids_a[in_a], return_counts=True)
    entry_b, many_b = np.unique(group_b[in_b].astype(np.int64) * size_b + ids_b[in_b], return_counts=True)
    (of_a, of_b), (own_a, own_b) = zip(np.divmod(entry_a, size_a), np.divmod(entry_b, size_b), strict=True)
    some = _written_out(size_b, size_a, own_a, of_a, many_a, own_b, of_b, many_b, row_of)
    rest = _written_out(
        size_b, size_a, ids_a[~in_a], group_a[~in_a], None, ids_b[~in_b], group_b[~in_b], None, row_of
    )
    return _summed(np.concatenate([some[0], rest[0]]), np.concatenate([some[1], rest[1]]))


def _written_out(size_b, size_a, ids_a, group_a, many_a, ids_b, group_b, many_b, row_of):
    in_b = np.bincount(group_b, minlength=len(row_of))
    first_b = np.cumsum(in_b) - in_b
    width = in_b[group_a]
    piece = np.cumsum(width) // MOST_LINKS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(width)]])
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = width[a:b]
        shift = first_b[group_a[a:b]] - (np.cumsum(some) - some)
        other = np.repeat(shift, some) + np.arange(int(some.sum()))
        key = (row_of[group_a[a:b]] * size_a + ids_a[a:b]) * size_b
        key = np.repeat(key, some) + ids_b[other]
        many = None if many_a is None else np.repeat(many_a[a:b], some) * many_b[other]
        if many is None and not len(keys):
            keys, times = np.unique(key, return_counts=True)
            continue
        many = np.ones(len(key), np.int64) if many is None else many
        keys, times = _summed(np.concatenate([keys, key]), np.concatenate([times, many]))
    return keys, times


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    head = np.flatnonzero(np.append(True, np.diff(keys) != 0)[: len(keys)])
    return keys[head], np.add.reduceat(times, head) if len(head) else times


def _aligner(definition: str, model: bytes) -> Aligner:
    """This Python worker's tokenizers, kept between its tasks."""
    name = "_foldwise_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    key = ("aligner", hash(definition), hash(model))
    if key not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept[key] = Aligner(definition, model)
    return kept[key]


def _ranges(uid: int, text: bytes, size: int) -> Iterator[tuple]:
    """The byte ranges of a text, each with the words around its ends."""
    whole = b" " + text
    chunks = -(-len(whole) // size)
    cuts = np.array([0, *(m.start() + 1 for m in _SAFE_CUT.finditer(text)), len(whole)])
    for k in range(chunks):
        low, high = k * size, min((k + 1) * size, len(whole))
        begin = int(cuts[np.searchsorted(cuts, low, "right") - 1])
        end = int(cuts[np.searchsorted(cuts, high, "left")])
        yield uid, k, chunks, begin, low - begin, high - begin, whole[begin:end]


def compose(left: tuple, right: tuple) -> tuple[tuple, tuple | None]:
    """The fragment of two neighbours, and the group that closes at their seam, if one does.

    A fragment is ``(has, prefix_a, prefix_b, suffix_a, suffix_b)``; without a common end
    (``has``) all its tokens are its prefix. The operation is associative.
    """
    join = lambda x, y: np.concatenate([x, y])
    if not left[0]:
        return (right[0], join(left[1], right[1]), join(left[2], right[2]), right[3], right[4]), None
    middle = (join(left[3], right[1]), join(left[4], right[2]))
    if not right[0]:
        return (True, left[1], left[2], *middle), None
    return (True, left[1], left[2], right[3], right[4]), middle


def _block_schema(id_type: T.DataType, with_groups: bool) -> T.StructType:
    counts = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("n_a", "n_b", "n_groups", "n_links")]
    return T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("ids", T.ArrayType(id_type)),
            *counts,
            T.StructField("digests", T.ArrayType(T.StringType())),
            T.StructField("codes", T.ArrayType(T.LongType())),
            T.StructField("documents", T.ArrayType(T.IntegerType())),
            T.StructField("pairs", T.BinaryType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
        ]
        + [T.StructField("groups", T.ArrayType(T.StringType()))] * with_groups
    )


def _block(name: str, ids: pa.Array, found: Closed, with_groups: bool) -> pa.RecordBatch:
    """One row for some documents: their distinct pairs once, and each document's places in them."""
    codes, places = np.unique(found.codes, return_inverse=True)
    digests = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in found.texts]
    lists = [ids, *(pa.array(np.asarray(x, np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links))]
    lists += [pa.array(digests, pa.string())]
    lists += [pa.array(codes), pa.array(np.bincount(places, minlength=len(codes)).astype(np.int32))]
    columns = [pa.array([name])]
    columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    for numbers in (found.pairs, places, found.times):
        columns.append(pa.array([np.asarray(numbers, np.int32).tobytes()], pa.binary()))
    names = "block ids n_a n_b n_groups n_links digests codes documents pairs places times".split()
    if with_groups:
        texts = pa.array([bytes(t).decode() for t in found.texts], pa.string())
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts))
        names.append("groups")
    return pa.RecordBatch.from_arrays(columns, names=names)


def aligned_blocks(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    definition: str,
    model: bytes,
    chunk_bytes: int = CHUNK_BYTES,
    with_groups: bool = False,
) -> DataFrame:
    """Blocks of aligned documents, written: the input of ``pair_counts`` and ``read_blocks``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((definition, model))  # two tokenizer files, some MB
    schema = _block_schema(docs.schema[id_col].dataType, with_groups)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    is_long = F.coalesce(F.octet_length("text") >= chunk_bytes, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(*shared.value)
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in tokens.text_slices(batch, "text", SLICE_BYTES):
                ids = batch.column("id").slice(first, len(texts))
                yield _block(f"{task}-{count}", ids, _whole(own, texts), with_groups)
                count += 1

    blocks = materialize(rows.where(~is_long).mapInArrow(short, schema), "aligned")
    long = rows.where(is_long)
    if long.isEmpty():
        return blocks
    composed = _long_blocks(long, shared, schema, chunk_bytes, with_groups)
    return blocks.unionByName(materialize(composed, "aligned-long"))


def _whole(own: Aligner, texts: pa.Array) -> Closed:
    """Groups of whole texts; NULL and empty ones have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    filled = pc.greater(pc.binary_length(texts), 0)
    spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
    found = own.tokenize(pc.if_else(filled, spaced, texts))
    return found.closed(found.common_ends())


def _part_rows(uid, k, place, seam: bool, ends: list[tuple], same, closed: Closed) -> pa.RecordBatch:
    """Rows of ``_PART``: open ends and closed groups of fragments, or of seams."""
    edges = np.concatenate([[0], np.cumsum(closed.pairs)]).astype(np.int32)
    lists = [
        pa.array([np.asarray(e[i], np.int32) for e in ends], pa.list_(pa.int32())) for i in range(1, 5)
    ]
    numbers = (closed.n_a, closed.n_b, closed.n_groups, closed.n_links)
    columns = [
        pa.array(uid, pa.int64()),
        pa.array(k, pa.int32()),
        pa.array(place, pa.int32()),
        pa.array(np.full(len(ends), seam)),
        pa.array([bool(e[0]) for e in ends]),
        *lists,
        pa.array(np.asarray(same, bool)),
        *(pa.array(np.asarray(x, np.int64)) for x in numbers),
        pa.array([bytes(t) for t in closed.texts], pa.binary()),
        pa.ListArray.from_arrays(pa.array(edges), pa.array(closed.codes)),
        pa.ListArray.from_arrays(pa.array(edges), pa.array(closed.times.astype(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_names(_PART))


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))
_NOTHING = (False, *_NONE, *_NONE)


def _groups_of(own: Aligner, made: list[tuple]) -> Closed:
    """Single groups ``(ids_a, ids_b)``, one row each."""
    row_a = np.repeat(np.arange(len(made)), [len(a) for a, _ in made])
    row_b = np.repeat(np.arange(len(made)), [len(b) for _, b in made])
    ids_a, ids_b = (np.concatenate([_NONE[0], *side]).astype(np.int64) for side in zip(*made, strict=True))
    return closed_groups(own, len(made), ids_a, row_a, row_a, ids_b, row_b, row_b)


def _long_blocks(long: DataFrame, shared, schema: T.StructType, chunk_bytes: int, with_groups: bool) -> DataFrame:
    """One block per long text, put together from fragments of its byte ranges."""
    id_field = T.StructField("id", schema["ids"].dataType.elementType)
    chunk_schema = T.StructType([id_field, *T._parse_datatype_string(_CHUNK).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.binary()]
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                ranges = list(_ranges(uid, text.as_py().encode(), chunk_bytes))
                uid += 1
                key = batch.column("id").take(pa.array(np.full(len(ranges), i)))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*ranges, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([key, *columns], names=chunk_schema.names)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(*shared.value)
        for batch in batches:
            for first, texts in tokens.text_slices(batch, "segment", SLICE_BYTES):
                part = batch.slice(first, len(texts))
                uid, k, low, high = (
                    part.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "k", "low", "high")
                )
                found = own.tokenize(texts.cast(pa.large_binary()).cast(pa.large_string()))
                found.within(low, high)
                common = found.common_ends()
                ends = found.open_ends(common)
                yield _part_rows(uid, k, k, False, ends, found.same, found.closed(common))

    def reduce_ends(table: pa.Table) -> pa.Table:
        """Compose neighbours; the groups that close between them are rows of their own."""
        whole, made, places = None, [], []
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        for row in rows:
            one = (row["has"], *(np.array(row[n], np.int64) for n in names))
            whole, middle = (one, None) if whole is None else compose(whole, one)
            if middle is not None:
                made.append(middle)
                places.append(row["place"])
        uid, k, own = rows[0]["uid"], rows[0]["k"] // FAN, _aligner(*shared.value)
        batches = [
            _part_rows([uid], [k], [rows[0]["place"]], False, [whole], [True], _groups_of(own, [_NONE]))
        ]
        if made:
            n = len(made)
            batches.append(
                _part_rows([uid] * n, [k] * n, places, True, [_NOTHING] * n, [True] * n, _groups_of(own, made))
            )
        return pa.Table.from_batches(batches)

    def assemble(table: pa.Table) -> pa.Table:
        """The rows of one text in order: its first group, then ranges and the seams before them."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["place"], not r["seam"]))
        own = _aligner(*shared.value)
        first = next(r for r in rows if r["prefix_a"] is not None)
        opening = _groups_of(own, [(np.array(first["prefix_a"], np.int64), np.array(first["prefix_b"], np.int64))])
        if not all(r["same"] for r in rows) or not first["has"] or first["suffix_a"] or first["suffix_b"]:
            found = _groups_of(own, [_NONE])
        else:
            codes = np.concatenate([opening.codes, *(np.array(r["codes"], np.int64) for r in rows)])
            times = np.concatenate([opening.times, *(np.array(r["times"], np.int64) for r in rows)])
            codes, place = np.unique(codes, return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, place, times)
            texts = [bytes(opening.texts[0]), *(r["groups"] for r in rows)]
            counts = {
                n: np.array([getattr(opening, n)[0] + sum(r[n] for r in rows)])
                for n in ("n_a", "n_b", "n_groups", "n_links")
            }
            found = Closed(
                **counts,
                texts=[b";".join(t for t in texts if t)],
                codes=codes,
                times=sums,
                pairs=np.array([len(codes)]),
            )
        uid = rows[0]["uid"]
        block = _block(f"long-{uid}", pa.array([uid], pa.int64()), found, with_groups)
        return pa.Table.from_batches([block])

    names = _names(_OPEN)[1:]
    chunks = materialize(long.mapInArrow(cut, chunk_schema), "ranges")
    most = chunks.agg(F.max("chunks")).first()[0]
    # Dealt evenly: the ranges of one long text are for many tasks.
    parts = materialize(chunks.repartition("uid", "k").mapInArrow(fragments, _PART), "fragments")
    pieces, ends = parts.select(_CLOSED), parts.select("uid", "k", "place", "has", *names)
    while True:  # a text of n ranges takes log n rounds to the base FAN
        group = ends.groupBy("uid", F.floor(F.col("k") / FAN))
        level = materialize(group.applyInArrow(reduce_ends, _PART), "composed")
        pieces = pieces.unionByName(level.where("seam").select(_CLOSED))
        ends = level.where("NOT seam").select("uid", "k", "place", "has", *names)
        if most <= FAN:
            break
        most = -(-most // FAN)
    # The whole text's fragment: what is before its first common end is its first group.
    roots = ends.drop("k", "place")
    empty = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in roots.schema.fields[1:]]
    root = roots.selectExpr(
        "uid", "-1 AS place", "true AS seam", "true AS same", "0L AS n_a", "0L AS n_b", "0L AS n_groups",
        "0L AS n_links", "binary('') AS groups", "array()::array<bigint> AS codes",
        "array()::array<bigint> AS times", "has", *names,
    )
    rows = pieces.selectExpr("*", *empty).unionByName(root)
    fields = [f if f.name != "ids" else T.StructField("ids", T.ArrayType(T.LongType())) for f in schema]
    whole = rows.groupBy("uid").applyInArrow(assemble, T.StructType(fields))
    keys = chunks.where("k = 0").select(F.col("uid").alias("_uid"), "id")
    own = F.array("id").alias("ids")
    joined = whole.join(keys, whole.ids[0] == keys["_uid"])
    return joined.select(*[own if c == "ids" else F.col(c) for c in schema.names])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(code, documents)``: how many documents hold a pair linked. A code is the first id times
    the size of the second vocabulary, plus the second id."""
    held = blocks.select(F.explode(F.arrays_zip("codes", "documents")).alias("x"))
    return held.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.documents").alias("documents"))


def read_blocks(blocks: DataFrame, size_b: int) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per document, and
    ``groups`` if the blocks hold them."""
    counts = materialize(pair_counts(blocks), "pair-counts")
    of_a = F.expr(f"code div {size_b}")
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("documents").alias("highest"))
    counts = counts.withColumn("a", of_a).join(highest, "a")
    counts = counts.select("code", "documents", (F.col("documents") == F.col("highest")).alias("best"))
    held = blocks.select("block", F.explode("codes").alias("code"))
    found = held.join(counts, "code").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("code", "documents", "best"))).alias("found")
    )
    found = found.select(
        F.col("block").alias("_block"),
        F.transform("found", lambda x: x.documents).alias("counts"),
        F.transform("found", lambda x: x.best).alias("best"),
    )
    # Blocks without any pair have no row in ``found``.
    joined = blocks.drop("codes", "documents").join(found, F.col("block") == F.col("_block"), "left")
    schema = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    plain = ["n_a", "n_b", "n_groups", "n_links"]
    groups = [T.StructField("groups", T.StringType())] if "groups" in blocks.columns else []
    id_type = blocks.schema["ids"].dataType.elementType
    fields = [T.StructField("id", id_type), *T._parse_datatype_string(schema).fields, *groups]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = {c: row.column(c).flatten() for c in ("ids", *plain, "digests", "counts", "best")}
                pairs, places, times = (
                    np.frombuffer(row.column(c)[0].as_py(), np.int32).astype(np.int64)
                    for c in ("pairs", "places", "times")
                )
                counts = own["counts"].to_numpy(zero_copy_only=False).astype(np.int64)
                best = own["best"].to_numpy(zero_copy_only=False).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(pairs)])
                sums = [
                    np.diff(np.concatenate([[0], np.cumsum(times * values[places])])[edges])
                    for values in (best, counts)
                ]
                columns = [own["ids"], *(own[c] for c in plain), *map(pa.array, sums), own["digests"]]
                columns += [row.column(g.name).flatten() for g in groups]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return joined.mapInArrow(spread, T.StructType(fields))


def align_documents(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    definition: str,
    model: bytes,
    chunk_bytes: int = CHUNK_BYTES,
    with_groups: bool = False,
) -> DataFrame:
    """One row per document, see ``read_blocks``; ``groups`` is ``a1,a2|b1;a3|b2,b3`` in order.

    ``definition`` is a byte-level tokenizer (side A, given the text behind a space), ``model`` a
    sentencepiece model that adds this space itself (side B). Texts that are NULL, empty, or not
    given back byte for byte by both sides have zeros and an empty digest. Every row is a document:
    repeated ids and rows count each for themselves, NULL ids stay. An empty table gives no row.
    """
    blocks = aligned_blocks(docs, id_col, text_col, definition, model, chunk_bytes, with_groups)
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    return read_blocks(blocks, size_b)
