"""Benchmark passages in documents: CGK embeddings, bit-sampling LSH, exact edit verification.

Texts are sequences of lower-cased words (runs of letters and digits; in scripts without spaces every
character is a word). An item of ``n`` words is found where some stretch of a document is within
``floor(edit_rate * n)`` word edits of it, so an item of few words only where it stands unchanged.

* An item cut into one block more than the edits allowed keeps a block whole (pigeonhole), so
  item-sized windows need only stand where a document has a block of an item. No match is lost by
  this choice of windows.
* Every window and item is embedded by the CGK random walk: a symbol is written, and a random bit
  of step and symbol says whether the walk goes on to the next one. Edit distance becomes Hamming
  distance of the outputs.
* Each repetition samples a few output places; windows and items with equal samples are
  candidates. A place behind the end of a text agrees with nothing. Repetitions are added until
  items that are edited as far as is allowed, and stand between other words, collide with the target
  recall in one of their windows. The buckets drop over nine in ten unrelated windows of ordinary
  prose, fewer where single words are a third of a text; nothing is lost or added by that.
* Candidates are verified by the exact edit distance to the best stretch around the window.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDIT_RATE = 0.2
RECALL = 0.99
MIN_WORDS = 1
SAMPLES = 2
#: Steps of the walk that are sampled, as a share of the words: nearly all walks read on that long.
WALK = 1.5
MOST_REPETITIONS = 1024
TRIALS = 400
#: Items that one pass over the documents looks for; more items make more passes.
ITEMS_PER_PASS = 5000
WINDOWS_AT_ONCE = 1024
# Characters of scripts without spaces (Thai to Lao, kana, Han, Han compatibility).
_ALONE = "\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"[{_ALONE}]|[^\W_{_ALONE}]+")
_NOTHING, _SEVERAL = -1, -2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, elementwise."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64) * _MIX
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        return v ^ (v >> np.uint64(32))


def cgk_samples(windows: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sampled outputs of the random walk: ``(windows, repetitions, samples)``.

    ``windows`` holds symbols padded with -1, ``sizes`` the lengths of the items they may be;
    ``places[r]`` are fractions of the first ``WALK * size`` steps, so items and windows of one size
    are read at one place. An output of -1 lies behind the end of the text.
    """
    count, width = windows.shape
    reps, samples = places.shape
    padded = np.concatenate([windows, np.full((count, 1), -1)], axis=1)
    wanted = (places[None] * (WALK * sizes)[:, None, None]).astype(np.int64)
    at = np.zeros((count, reps), np.int64)
    out = np.full((count, reps, samples), -1, np.int64)
    rows, rep = np.arange(count)[:, None], np.arange(reps, dtype=np.uint64)[None]
    for step in range(int(wanted.max()) + 1):
        symbol = padded[rows, np.minimum(at, width)]
        for k in range(samples):
            here = wanted[:, :, k] == step
            out[:, :, k][here] = symbol[here]
        key = (symbol + 2).astype(np.uint64) * np.uint64(1_000_003) + np.uint64(step)
        at += (_mixed(key * np.uint64(4099) + rep) >> np.uint64(40)).astype(np.int64) & 1
    return out


def _keys(samples: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per repetition, of its samples, its number and the length."""
    reps = np.arange(samples.shape[1], dtype=np.uint64)[None]
    key = _mixed(reps + np.uint64(7919) * sizes.astype(np.uint64)[:, None])
    for k in range(samples.shape[2]):
        key = _mixed(key ^ (samples[:, :, k] + 2).astype(np.uint64))
    return key


def best_edits(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Least edits between ``item`` and any part of ``stretch``, and that part's start and end."""
    m = len(stretch)
    steps = np.arange(m + 1)
    cost, start = np.zeros(m + 1, np.int64), steps.copy()
    for k, symbol in enumerate(item):
        swap, swap_start = cost[:-1] + (stretch != symbol), start[:-1]
        drop, drop_start = cost[1:] + 1, start[1:]
        take = swap <= drop
        best = np.concatenate([[k + 1], np.where(take, swap, drop)])
        origin = np.concatenate([[0], np.where(take, swap_start, drop_start)])
        # an inserted word costs one step to the right: a running minimum of cost - position
        level = best - steps
        running = np.minimum.accumulate(level)
        leader = np.maximum.accumulate(np.where(level == running, steps, 0))
        cost, start = running + steps, origin[leader]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class _Tokens(dict):
    """Numbers of white-space tokens, remembered for a bounded number of them."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        words = words_of(token)
        code = _SEVERAL if len(words) > 1 else self.vocabulary.get(words[0], 0) if words else _NOTHING
        if len(self) < 400_000:
            self[token] = code
        return code


class Matcher:
    """What a pass over the documents needs of its items; it is sent to the tasks."""

    def __init__(
        self,
        items: list[tuple[object, str]],
        edit_rate: float = EDIT_RATE,
        recall: float = RECALL,
        min_words: int = MIN_WORDS,
        seed: int = 11,
    ) -> None:
        kept = [(i, words_of(t or "")) for i, t in items]
        kept = [(i, w) for i, w in kept if len(w) >= min_words]
        self.ids = [i for i, _ in kept]
        self.tokens: _Tokens | None = None
        vocabulary = sorted({w for _, ws in kept for w in ws})
        self.vocabulary = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.items = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in kept]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.allowed = np.floor(edit_rate * self.sizes + 1e-9).astype(np.int64)
        self._blocks()
        self._buckets(recall, edit_rate, np.random.default_rng(seed))

    def _blocks(self) -> None:
        rows = []
        for number, (item, edits) in enumerate(zip(self.items, self.allowed, strict=True)):
            cuts = np.linspace(0, len(item), edits + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((int(b - a), self._hash(item[a:b])[0], number, int(a)))
        self.blocks = {}
        for length in sorted({r[0] for r in rows}):
            own = sorted(r[1:] for r in rows if r[0] == length)
            self.blocks[length] = (
                np.array([r[0] for r in own], np.uint64),
                np.array([r[1] for r in own], np.int64),
                np.array([r[2] for r in own], np.int64),
            )

    @staticmethod
    def _hash(block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.zeros(1, np.uint64)
            for symbol in block:
                total = total * _STEP + np.uint64(symbol)
        return _mixed(total)

    def _padded(self, parts: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(parts), max(map(len, parts), default=1)), -1, np.int64)
        for row, part in zip(out, parts, strict=True):
            row[: len(part)] = part
        return out

    def _buckets(self, recall: float, rate: float, random: np.random.Generator) -> None:
        """Repetitions for the target recall, measured on items edited as far as is allowed."""
        self.places = np.zeros((0, SAMPLES))
        self.keys, self.key_items = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not self.items:
            return
        windows, sizes, owners, trials = self._trial(random, rate)
        reps = 16
        while True:
            self.places = np.random.default_rng(5).random((reps, SAMPLES))
            hit = np.zeros(len(trials), bool)
            for at in range(0, len(windows), WINDOWS_AT_ONCE):
                part = slice(at, at + WINDOWS_AT_ONCE)
                whole = self._padded([self.items[trials[k]] for k in owners[part]])
                a = cgk_samples(self._padded(windows[part]), sizes[part], self.places)
                b = cgk_samples(whole, sizes[part], self.places)
                np.logical_or.at(hit, owners[part], ((a == b) & (a >= 0)).all(axis=2).any(axis=1))
            if hit.mean() >= recall or reps >= MOST_REPETITIONS:
                break
            reps *= 2
        samples = cgk_samples(self._padded(self.items), self.sizes, self.places)
        items, rep = np.nonzero((samples >= 0).all(axis=2))
        keys = _keys(samples, self.sizes)[items, rep]
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_items = keys[order], items[order]

    def _trial(self, random: np.random.Generator, rate: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of edited items between other words: words, sizes, trial numbers, the trials' items."""
        trials = np.resize(random.permutation(len(self.items)), TRIALS)
        windows, sizes, owners = [], [], []
        for number, k in enumerate(trials):
            item, size = self.items[k], len(self.items[k])
            words = list(item)
            for _ in range(math.floor(rate * size + 1e-9)):
                at, kind = int(random.integers(len(words))), int(random.integers(3))
                if kind == 0:
                    words[at] = 0
                elif kind == 1:
                    words.insert(at, 0)
                elif len(words) > 1:
                    del words[at]
            text = np.array([0] * size + words + [0] * size, np.int64)
            seeds = self._windows(text)
            starts = np.unique((seeds[:, 0] - seeds[:, 1])[seeds[:, 2] == size])
            windows += [text[max(x, 0) : x + size] for x in starts.tolist()]
            sizes += [size] * len(starts)
            owners += [number] * len(starts)
        return windows, np.array(sizes), np.array(owners), trials

    def _windows(self, symbols: np.ndarray) -> np.ndarray:
        """``(start, size)`` of the item-sized windows, where a block of an item stands."""
        known = np.concatenate([[0], np.cumsum(symbols > 0)])
        found = []
        for length, (hashes, items, offsets) in self.blocks.items():
            whole = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(whole):
                continue
            with np.errstate(over="ignore"):
                own = np.zeros(len(whole), np.uint64)
                for k in range(length):
                    own = own * _STEP + symbols[whole + k].astype(np.uint64)
            own = _mixed(own)
            first, last = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            many = last - first
            place = np.repeat(whole, many)
            row = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
            row += np.repeat(first, many)
            found.append(np.stack([place, offsets[row], self.sizes[items[row]]], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def matches(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """Per text ``(item, edits, first word, end word)``: the best place of every item found.

        The texts are searched as one sequence; the 0 behind each stands in no block.
        """
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = ends - np.array([len(t) + 1 for t in texts])
        joined = np.zeros(ends[-1] if len(texts) else 0, np.int64)
        for at, text in zip(begins, texts, strict=True):
            joined[at : at + len(text)] = text
        seeds = self._windows(joined)
        own = np.searchsorted(ends, seeds[:, 0], "right")
        windows = np.unique(np.stack([own, seeds[:, 0] - seeds[:, 1], seeds[:, 2]], axis=1), axis=0)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for at in range(0, len(windows), WINDOWS_AT_ONCE):
            part = windows[at : at + WINDOWS_AT_ONCE]
            low = np.maximum(part[:, 1], begins[part[:, 0]])
            high = np.minimum(part[:, 1] + part[:, 2], ends[part[:, 0]] - 1)
            cut = [joined[x:y] for x, y in zip(low, high, strict=True)]
            samples = cgk_samples(self._padded(cut), part[:, 2], self.places)
            keys = _keys(samples, part[:, 2])
            first = np.searchsorted(self.keys, keys)
            last = np.where((samples >= 0).all(axis=2), np.searchsorted(self.keys, keys, "right"), first)
            candidates = set()
            for w, r in zip(*np.nonzero(last > first), strict=True):
                candidates |= {(w, i) for i in self.key_items[first[w, r] : last[w, r]].tolist()}
            for w, item in sorted(candidates):
                text, start, size = part[w].tolist()
                allowed = int(self.allowed[item])
                x = max(int(begins[text]), start - 2 * allowed)
                y = min(int(ends[text]) - 1, start + size + 2 * allowed)
                edits, a, b = best_edits(self.items[item], joined[x:y])
                found = (edits, x + a - int(begins[text]), x + b - int(begins[text]))
                if edits <= allowed and found < best.get((text, item), (edits + 1,)):
                    best[text, item] = found
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for (text, item), found in sorted(best.items()):
            out[text].append((item, *found))
        return out

    def symbols(self, text: str | None) -> np.ndarray:
        """The text's words as numbers of the items' vocabulary; 0 for words that no item has."""
        if self.tokens is None:
            self.tokens = _Tokens(self.vocabulary)
        tokens = (text or "").split()
        codes = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        if len(codes) and codes.min() < 0:
            if (codes == _SEVERAL).any():
                words = words_of(text)
                return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
            codes = codes[codes != _NOTHING]
        return codes


def _passes(items: DataFrame, id_col: str, text_col: str, **settings: float) -> list[Matcher]:
    """One matcher per block of items; a block is bounded, so it can be sent to every task."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where("text is not null")
    blocks = max(1, math.ceil(rows.count() / ITEMS_PER_PASS))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    made = []
    for number in range(blocks):
        own = sorted(map(tuple, rows.where(block == number).collect()), key=repr)
        made.append(Matcher(own, **settings))
    return made


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str,
    text_col: str,
    item_id_col: str,
    item_text_col: str,
    **settings: float,
) -> DataFrame:
    """``(id, item_id, edits, n_words, start, end)``: the best place of every item in every document.

    ``start`` and ``end`` are code points of the lower-cased text. ``settings`` are ``edit_rate``,
    ``recall`` and ``min_words`` (1; shorter items are not looked for). NULL and empty texts hold nothing,
    NULL ids are carried, repeated rows and items give their own rows; other columns are not read.
    """
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("item_id", items.schema[item_id_col].dataType),
            T.StructField("edits", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for matcher in _passes(items, item_id_col, item_text_col, **settings):

        def find(batches: Iterator[pd.DataFrame], matcher: Matcher = matcher) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                places = matcher.matches([matcher.symbols(t) for t in batch["text"]])
                for key, text, hits in zip(batch["id"], batch["text"], places, strict=True):
                    if hits:
                        spans = [m.span() for m in WORD.finditer(text.lower())]
                        found += [
                            (key, matcher.ids[i], e, int(matcher.sizes[i]), spans[a][0], spans[b - 1][1])
                            for i, e, a, b in hits
                        ]
                yield pd.DataFrame(found, columns=schema.names)

        part = rows.mapInPandas(find, schema)
        out = part if out is None else out.unionByName(part)
    return out


def is_contaminated(
    items: DataFrame, item_id_col: str, item_text_col: str, text: Column, **settings: float
) -> Column:
    """Whether a text holds any item, by the same search; false for NULL."""
    flags = [_holds(m, text) for m in _passes(items, item_id_col, item_text_col, **settings)]
    return reduce(Column.__or__, flags)


def _holds(matcher: Matcher, text: Column) -> Column:
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        found = matcher.matches([matcher.symbols(t) for t in texts])
        return pd.Series([bool(f) for f in found], dtype=bool)

    return holds(text)
