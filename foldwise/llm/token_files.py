"""Token ids in binary shards, with a minimal perfect hash index from document keys to places.

A dataset is a folder that all executors can reach:

* ``ids-<n>-<attempt>.bin``: a 16-byte header (``FWTOKEN1``, bytes per id, zeros) and the raw
  little-endian ids of the shard's documents, in ascending order of their keys;
* ``documents/``: Parquet with one row per document and its place;
* ``index-<n>-<attempt>.npz``: a minimal perfect hash of the keys of one part of the key space.

A shard or index file belongs to the dataset only if a finished task has returned its name, so a
task that is lost and run again leaves at most a file that nothing names.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.tokens import encoder, text_slices
from foldwise.workspace import scratch_path

MAGIC = b"FWTOKEN1"
HEADER = 16
#: Keys of one index file.
KEYS_PER_INDEX = 20_000
#: Bits per key still to be placed, of each level of the hash.
GAMMA = 2.0
LEVELS = 32


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def _mixed(values: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = values + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * level + 1)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: one bit array per level, ranks by counting.

    A key sits on the first level where no other key left has its place. The few that find none in
    ``LEVELS`` levels are listed. Two bits per key and level left, about 3.7 bits per key in all.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.ranks = []
        base = 0
        for bits in levels:
            self.ranks.append(base + np.concatenate([[0], np.cumsum(bits)]))
            base += int(bits.sum())
        self.base = base

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, levels = np.unique(hashes.astype(np.uint64)), []
        while len(left) and len(levels) < LEVELS:
            size = max(8, int(GAMMA * len(left)))
            place = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        return cls(levels, left)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slots from 0 to the number of keys; any slot, or -1, for what is no key."""
        hashes = hashes.astype(np.uint64)
        out = np.full(len(hashes), -1, np.int64)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            todo = out < 0
            place = (_mixed(hashes[todo], level) % np.uint64(len(bits))).astype(np.int64)
            out[todo] = np.where(bits[place], ranks[place], -1)
        if len(self.rest):
            todo = np.flatnonzero(out < 0)
            at = np.minimum(np.searchsorted(self.rest, hashes[todo]), len(self.rest) - 1)
            out[todo] = np.where(self.rest[at] == hashes[todo], self.base + at, -1)
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        packed = {f"level{k}": np.packbits(bits) for k, bits in enumerate(self.levels)}
        sizes = np.array([len(bits) for bits in self.levels], np.int64)
        return packed | {"sizes": sizes, "rest": self.rest}

    @classmethod
    def from_arrays(cls, arrays: dict[str, np.ndarray]) -> PerfectHash:
        sizes = arrays["sizes"].tolist()
        levels = [np.unpackbits(arrays[f"level{k}"])[:n].astype(bool) for k, n in enumerate(sizes)]
        return cls(levels, arrays["rest"])


def _key(id_column: F.Column, copy: F.Column) -> F.Column:
    """64-bit hash of a key: the id, and which of the documents of that id."""
    return F.xxhash64(F.lit("key"), id_column.cast("string"), id_column.isNull(), copy.cast("int"))


def _fingerprint(id_column: F.Column, copy: F.Column) -> F.Column:
    """A second hash of the key, stored to tell other keys."""
    return F.xxhash64(F.lit("print"), id_column.cast("string"), id_column.isNull(), copy.cast("int"))


def write_token_files(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    definition: str,
    mode: str,
    end_id: int,
    bytes_per_id: int = 2,
    shards: int | None = None,
    root: str | None = None,
) -> str:
    """Encode ``docs`` and write a dataset; returns its folder.

    Documents stand in ascending order of their ids, NULL ids first, documents of one id in order of
    their texts, each copy under a key of its own. NULL and empty texts are one ``end_id``.
    ``shards`` defaults to the session's shuffle partitions. Other columns are not read.
    """
    spark = docs.sparkSession
    root = root or scratch_path(spark, "token-files")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bytes_per_id not in (2, 4):
        raise ValueError("an id takes 2 or 4 bytes")
    shared = spark.sparkContext.broadcast(definition)
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("copy", T.IntegerType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("file", T.StringType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, mode)
        store, folder = _store(root)
        store.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"ids-{shard:06d}-{uuid.uuid4().hex[:12]}.bin"
        at, last, copy = 0, object(), 0
        kept = []
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(MAGIC + bytes([bytes_per_id]) + bytes(HEADER - len(MAGIC) - 1))
            for batch in batches:
                for first, texts in text_slices(batch, "text"):
                    encoded = [np.append(ids, end_id) for ids in own.encode(texts)]
                    keys = batch.column("id").slice(first, len(encoded))
                    sizes = np.array([len(x) for x in encoded], np.int32)
                    joined = np.concatenate(encoded)
                    if bytes_per_id == 2 and joined.max() > 0xFFFF:
                        raise ValueError("the ids need 4 bytes")
                    out.write(joined.astype(f"<u{bytes_per_id}").tobytes())
                    copies = []
                    for key in keys.to_pylist():
                        copy = copy + 1 if key == last else 0
                        last = key
                        copies.append(copy)
                    ends = at + np.cumsum(sizes, dtype=np.int64)
                    kept.append(
                        pa.RecordBatch.from_arrays(
                            [
                                keys,
                                pa.array(copies, pa.int32()),
                                pa.array(np.full(len(sizes), shard, np.int32)),
                                pa.array([name] * len(sizes)),
                                pa.array(ends - sizes),
                                pa.array(sizes),
                            ],
                            names=schema.names,
                        )
                    )
                    at = int(ends[-1])
        yield from kept  # places count only once the file is closed

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(write, schema).write.parquet(f"{root}/documents")
    _write_index(spark, root)
    return root


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(id, copy, shard, file, first, n_tokens, start)``; ``start`` counts all ids before."""
    rows = spark.read.parquet(f"{root}/documents")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select(  # one row per shard
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")
    )
    return rows.join(before, "shard").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _write_index(spark: SparkSession, root: str) -> None:
    """One perfect hash per part of the key space; parts hold about ``KEYS_PER_INDEX`` keys."""
    places = read_documents(spark, root)
    parts = max(1, -(-places.count() // KEYS_PER_INDEX))
    keyed = places.select(
        _key(F.col("id"), F.col("copy")).alias("key"),
        _fingerprint(F.col("id"), F.col("copy")).alias("print"),
        "shard",
        "file",
        "first",
        "n_tokens",
        "start",
    ).withColumn("part", F.pmod("key", F.lit(parts)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        if rows["key"].duplicated().any():
            raise ValueError("two keys have the same 64-bit hash")
        hashes = rows["key"].to_numpy().view(np.uint64)
        perfect = PerfectHash.build(hashes)
        order = np.empty(len(rows), np.int64)
        order[perfect.slots(hashes)] = np.arange(len(rows))
        rows = rows.iloc[order]
        names, place = np.unique(rows["file"].to_numpy(str), return_inverse=True)
        columns = {
            "print": rows["print"].to_numpy(),
            "first": rows["first"].to_numpy(),
            "start": rows["start"].to_numpy(),
            "n_tokens": rows["n_tokens"].to_numpy(),
            "shard": rows["shard"].to_numpy(),
            "place": place.astype(np.int32),
            "names": names,
        }
        data = io.BytesIO()
        np.savez(data, **columns, **perfect.arrays())
        store, folder = _store(root)
        name = f"index-{part:06d}-{uuid.uuid4().hex[:12]}.npz"
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(data.getbuffer())
        return pd.DataFrame({"part": [part], "name": [name], "parts": [parts]})

    made = keyed.groupBy("part").applyInPandas(build, "part long, name string, parts long")
    made.write.parquet(f"{root}/index")


class _Index:
    """One index file, read whole: a part is bounded."""

    def __init__(self, root: str, name: str) -> None:
        store, folder = _store(root)
        with store.open_input_file(f"{folder}/{name}") as file:
            with np.load(io.BytesIO(file.read())) as data:
                self.data = {k: data[k] for k in data.files}
        self.hash = PerfectHash.from_arrays(self.data)

    def find(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for keys that the dataset has not."""
        slots = self.hash.slots(keys.view(np.uint64))
        there = (slots >= 0) & (self.data["print"][slots] == prints)
        return np.where(there, slots, -1)


def look_up(spark: SparkSession, root: str, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, copy, file, first, n_tokens, shard, start)`` of keys, through the index alone.

    ``keys`` has the ids and may have ``copy`` (0 if not). A key takes one probe of its part's hash;
    ids that the dataset has not, give no row.
    """
    index = spark.read.parquet(f"{root}/index")
    copy = F.col("copy") if "copy" in keys.columns else F.lit(0)
    asked = keys.select(F.col(f"`{id_col}`").alias("id"), copy.cast("int").alias("copy"))
    asked = asked.withColumns({"key": _key(F.col("id"), F.col("copy")), "print": _fingerprint(F.col("id"), F.col("copy"))})
    one = index.select("parts").first()
    if one is None:
        parts = 1
    else:
        parts = one.parts
    asked = asked.withColumn("part", F.pmod("key", F.lit(parts))).join(index.drop("parts"), "part")
    schema = T.StructType(
        [
            T.StructField("id", asked.schema["id"].dataType),
            T.StructField("copy", T.IntegerType()),
            T.StructField("file", T.StringType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("start", T.LongType()),
        ]
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, _Index] | None = None
        for batch in batches:
            names = batch.column("name").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if opened is None or opened[0] != names[a]:
                    opened = (names[a], _Index(root, names[a]))
                own = batch.slice(a, b - a)
                data = opened[1].data
                slots = opened[1].find(own.column("key").to_numpy(), own.column("print").to_numpy())
                there = np.flatnonzero(slots >= 0)
                slots = slots[there]
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("id").take(pa.array(there)),
                        own.column("copy").take(pa.array(there)),
                        pa.array(data["names"][data["place"][slots]].astype(object), pa.string()),
                        pa.array(data["first"][slots]),
                        pa.array(data["n_tokens"][slots].astype(np.int32)),
                        pa.array(data["shard"][slots].astype(np.int32)),
                        pa.array(data["start"][slots]),
                    ],
                    names=schema.names,
                )

    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(probe, schema)


def read_ids(root: str, places: DataFrame, with_ids: bool = False) -> DataFrame:
    """``places`` with ``ids_crc32`` (and ``ids``) read back from the shards, one range per row."""
    fields = [T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([*places.schema.fields, *fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        name, file, width = None, None, 0
        for batch in batches:
            crcs, payload = [], []
            for own, first, size in zip(
                batch.column("file").to_pylist(),
                batch.column("first").to_pylist(),
                batch.column("n_tokens").to_pylist(),
                strict=True,
            ):
                if own != name:
                    if file is not None:
                        file.close()
                    name, file = own, store.open_input_file(f"{folder}/{own}")
                    head = file.read_at(HEADER, 0)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"{own} is no shard of token ids")
                    width = head[len(MAGIC)]
                raw = file.read_at(size * width, HEADER + first * width)
                ids = np.frombuffer(raw, f"<u{width}")
                if len(ids) != size:
                    raise ValueError(f"{own} ends before its last document")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                if with_ids:
                    payload.append(ids.astype(np.int32))
            arrays = [pa.array(crcs, pa.int64())]
            arrays += [pa.array(payload, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    by_place = places.repartition("file", F.floor(F.col("first") / (1 << 20)))
    return by_place.sortWithinPartitions("file", "first").mapInArrow(read, schema)
