"""SimHash fingerprints and near-duplicate groups by a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.components import connected_components
from foldwise.workspace import materialize

#: Two fingerprints of 8 bytes that differ in at most 4 bits share at least 4 positional bytes.
BYTES = 8
SEED = 42
#: Fingerprints of one posting list that are compared in one piece.
TILE_ROWS = 512


def simhash64(text: str, n_words: int = 4) -> int:
    """Majority bits of the XXH64 of all word shingles of ``text``, repeats included.

    A-Z are lowered, words are cut at ASCII white space. Fewer words than ``n_words`` make one
    shingle; no word at all gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    span = min(n_words, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - span + 1]
    hashes = [
        xxhash.xxh64_intdigest(joined[a:b], SEED)
        for a, b in zip(starts.tolist(), ends[span - 1 :].tolist(), strict=True)
    ]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the memory of a very long text
        part = np.array(hashes[at : at + 65536], np.uint64)
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n_words: int = 4) -> DataFrame:
    """``(id, fingerprint bigint)`` of every row; a NULL text counts as empty, so as 0."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t or "", n_words) for t in texts], dtype="int64")

    return docs.select(
        F.col(f"`{id_col}`").alias("id"), simhash(F.col(f"`{text_col}`")).alias("fingerprint")
    )


def index_positions(bytes_per_key: int = 3) -> list[tuple[int, ...]]:
    """Byte positions of the index keys: every 4 of the 8 positions contain one of them.

    Four bytes: all 70 sets. Three: the positions fall into the groups (0 1 2), (3 4 5), (6 7); a
    key is a whole group, or two positions of a group and one of the next (20 keys).
    """
    if bytes_per_key == 4:
        return list(combinations(range(BYTES), 4))
    if bytes_per_key != 3:
        raise ValueError("bytes_per_key is 3 or 4")
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    keys = [g for g in groups if len(g) == 3]
    for i, group in enumerate(groups):
        keys += [
            tuple(sorted((*pair, one)))
            for pair in combinations(group, 2)
            for one in groups[(i + 1) % len(groups)]
        ]
    return keys


def _postings(distinct: DataFrame, bytes_per_key: int) -> DataFrame:
    """``(key, fingerprint)``: the index lists in which a fingerprint stands."""

    def byte(position: int) -> F.Column:
        return F.shiftrightunsigned("fingerprint", 8 * position).bitwiseAND(F.lit(255))

    keys = []
    for number, positions in enumerate(index_positions(bytes_per_key)):
        key = F.lit(number).cast("long")
        for position in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte(position))
        keys.append(key)
    return distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))


def links_in(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the fingerprints that differ in at most ``max_bits``.

    Shared positional bytes are tallied per pair, pairs below the guaranteed count are left out,
    the others are verified by their differing bits. Found neighbours are visited once, so the
    result has fewer rows than ``values`` and connects what all pairs would connect.
    """
    values = np.unique(values)
    matches = BYTES - max_bits
    left, links = values, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            differs = left ^ one
            tally = (differs.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = (tally >= matches) & (np.bitwise_count(differs.view(np.uint64)) <= max_bits)
            found = left[near]
            links += [(int(one), int(x)) for x in found]
            frontier += list(found)
            left = left[~near]
    return links


def near_links(distinct: DataFrame, max_bits: int = 4, bytes_per_key: int = 3) -> DataFrame:
    """``(src, dst)`` links that connect all distinct fingerprints within ``max_bits``.

    Index lists longer than ``TILE_ROWS`` are cut into tiles, and each pair of tiles is a piece of
    work of its own, so no list is too long for a task; no pair of a list is left out.
    """
    if not 1 <= max_bits <= 4:
        raise ValueError("max_bits is from 1 to 4: beyond, the index keys don't reach all pairs")
    postings = _postings(distinct, bytes_per_key)
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int")
    pieces = (
        postings.join(lists, "key")
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .groupBy("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        .agg(F.collect_list("fingerprint").alias("values"))
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {x for v in batch["values"] for x in links_in(np.asarray(v, np.int64), max_bits)}
            yield pd.DataFrame(sorted(found), columns=["src", "dst"], dtype="int64")

    return pieces.select("values").mapInPandas(link, "src long, dst long").distinct()


def near_groups(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    n_words: int = 4,
    max_bits: int = 4,
    bytes_per_key: int = 3,
) -> DataFrame:
    """``(id, fingerprint, component_id, component)`` of every row of ``docs``.

    Fingerprints within ``max_bits`` bits are linked; ``component_id`` is the smallest id that is
    reachable; ``component`` is the component's least fingerprint, which tells components apart that
    repeated ids name alike. Equal fingerprints are one node, so copies cost nothing beyond their own rows. NULL
    and empty texts have fingerprint 0 and are linked like any other. Rows with a NULL id get a
    component like others; NULL is never the smallest id unless no row of the component has an id.
    Repeated ids stay repeated rows. Other columns of ``docs`` are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, n_words), "simhash")
    distinct = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    links = near_links(distinct.select("fingerprint"), max_bits, bytes_per_key)
    found = connected_components(links)
    of_fingerprint = (
        distinct.join(found, distinct.fingerprint == found.node, "left")
        .select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    )
    least = of_fingerprint.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = of_fingerprint.join(least, "component").select("fingerprint", "component_id", "component")
    return rows.join(labels, "fingerprint").select("id", "fingerprint", "component_id", "component")


def fingerprint_hex(fingerprint: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
