"""Best-fit packing of tokenized documents by exact complements.

Which lengths go together depends only on how many pieces there are of each length, and there are
at most ``capacity`` lengths: the driver plans on those counts, and Spark deals the pieces out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.tokens import encoder, text_slices
from foldwise.workspace import materialize

CAPACITY = 1024
#: Pieces of one length that are numbered in one go.
ROWS_PER_RUN = 512


class SumIndex:
    """Lengths whose sums fill a gap exactly: one, two or three of those still available."""

    def __init__(self, available: np.ndarray) -> None:
        self.available = available

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.available[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """The pair with the longest part; a length taken twice must be there twice."""
        small = np.arange(1, gap // 2 + 1)
        there = (self.available[small] > 0) & (self.available[gap - small] > 0)
        if gap % 2 == 0 and len(small):
            there[-1] = self.available[gap // 2] > 1
        found = np.flatnonzero(there)
        return [gap - int(small[found[0]]), int(small[found[0]])] if len(found) else None

    def triple(self, gap: int) -> list[int] | None:
        for longest in np.flatnonzero(self.available[: max(0, gap - 1)])[::-1].tolist():
            if 3 * longest < gap:
                break
            self.available[longest] -= 1
            rest = self.pair(gap - longest)
            self.available[longest] += 1
            if rest:
                return [longest, *rest]
        return None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``(times, lengths)``: sequences of the same make-up, as often as the counts allow.

    The longest length left opens a sequence. Its gap is filled exactly by one, two or three
    lengths where that can be done; otherwise the longest that fits (best fit) goes in and the
    smaller gap is tried again.
    """
    available = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        available[length] = count
    index = SumIndex(available)
    plan = []
    for longest in range(capacity, 0, -1):
        while available[longest] > 0:
            lengths, gap = [longest], capacity - longest
            available[longest] -= 1
            while gap:
                fill = index.exact(gap)
                if not fill:
                    fitting = np.flatnonzero(available[: gap + 1])
                    fill = [int(fitting[-1])] if len(fitting) else None
                if not fill:
                    break
                for length in fill:
                    available[length] -= 1
                lengths += fill
                gap -= sum(fill)
            used = Counter(lengths)
            more = min(int(available[x]) // n for x, n in used.items())
            for length, n in used.items():
                available[length] -= more * n
            plan.append((more + 1, lengths))
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, low, high, first sequence, offset)``: who of a length's pieces goes where."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return rows


def tokenized_pieces(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    definition: str,
    mode: str,
    end_id: int,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` and, on request, ``ids`` of every piece.

    A document is its token ids and the end id. Only documents of more than ``capacity`` ids are
    cut, and then only their first piece may be shorter. NULL texts count as empty.
    """
    fields = [
        T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType(fields)
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one file, some MB
    columns = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, mode)
        for batch in batches:
            keys = batch.column("id")
            for first, texts in text_slices(batch, "text"):
                rows, places, payload = [], [], []
                for k, ids in enumerate(own.encode(texts)):
                    ids = np.append(ids, end_id).astype("<u4")
                    head = len(ids) % capacity or min(capacity, len(ids))
                    starts = [0, *range(head, len(ids), capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        places.append(first + k)
                        rows.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        if with_ids:
                            payload.append(ids[a:b].astype(np.int32))
                table = np.array(rows, np.int64)
                arrays = [
                    keys.take(pa.array(places)),
                    pa.array(table[:, 0].astype(np.int32)),
                    *(pa.array(table[:, k]) for k in (1, 2, 3)),
                ] + [pa.array(payload, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` is read twice, so write it first.

    Pieces of one length are alike: they are numbered in runs of about ``ROWS_PER_RUN`` by a hash of
    the id, so that no length is too common for a task, and the plan says where each number goes.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # <= capacity rows
    counts = {r.length: r.n for r in counted}
    if not counts:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn(
            "offset", F.lit(0).cast("long")
        )
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    slots = spark.createDataFrame(
        _slots(plan_packing(counts, capacity)),
        "length long, low long, high long, first long, offset long",
    )
    runs = spark.createDataFrame(
        [(length, -(-n // ROWS_PER_RUN)) for length, n in counts.items()], "length long, runs long"
    )
    spread = pieces.join(F.broadcast(runs), "length").withColumn(
        "run", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("runs"))
    )
    before = (
        spread.groupBy("length", "run")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "before",
            F.sum("n").over(Window.partitionBy("length").orderBy("run")) - F.col("n"),
        )
        .drop("n")
    )
    within = Window.partitionBy("length", "run").orderBy("id", "piece", "ids_crc32")
    ranked = (
        spread.withColumn("place", F.row_number().over(within) - 1)
        .join(before, ["length", "run"])
        .withColumn("rank", F.col("before") + F.col("place"))
    )
    # one interval of a length's numbers per slot; both tables are bounded by the capacity
    slots = slots.withColumnRenamed("length", "of_length")
    placed = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("of_length")) & F.col("rank").between(F.col("low"), F.col("high") - 1),
    )
    return placed.select(
        *pieces.columns,
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"),
        F.col("offset"),
    )


def pack_documents(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    definition: str,
    mode: str,
    end_id: int,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its sequence and place.

    NULL and empty texts are one end id. NULL and repeated ids, repeated texts and empty tables are
    packed like any rows; other columns are not read.
    """
    pieces = tokenized_pieces(docs, id_col, text_col, definition, mode, end_id, capacity, with_ids)
    return pack(materialize(pieces, "pieces"), capacity)
