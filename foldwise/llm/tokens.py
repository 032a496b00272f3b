"""Token ids of whole texts by a given tokenizer, remembered per word.

A byte-pair tokenizer never merges across the pieces its pre-tokenizer cuts, so a text's ids are the
ids of its white-space separated parts, one after the other, and a part that came before need not be
encoded again. The cuts made here are places where the pre-tokenizer cuts in any case:

* ``spaces``: before a single space between two non-space characters (byte-level tokenizers whose
  pattern takes one space with the word behind it). Texts with other white space before a space are
  encoded whole.
* ``words``: at ASCII white space (tokenizers that drop white space).

Commas and full stops behind a letter are cut off as well.
"""

from __future__ import annotations

import json
import os
import sys
import types
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts remembered per Python worker; then it starts anew.
REMEMBERED = 250_000
#: White space (as Unicode has it) before a space.
_UNSAFE = r"[\s\x0b\x{85}\p{Z}] "
#: A part that is one word, perhaps behind a space, and holds no separator.
_ONE_WORD = {
    "spaces": r"^ ?[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+$",
    "words": r"^[^\s\x0b\x1c-\x1f\x{85}\p{Z}0]+$",
}
#: Commas and full stops behind a letter; some other capitals turn into a letter and a mark, which
#: would join the full stop.
_ENDS_IN_STOP = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}][.,]+$"

#: Words of letters that no normalizer changes and no pre-tokenizer cuts; the model takes them as they are.
_LETTERS = {
    "spaces": r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$",
    "words": r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$",
}
_PROBES = ("a", "word", "straße", "naïve", "ÿ", "abcdefghij" * 5)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: its own if it can be shown."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def byte_level_entries(definition: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
    parsed = json.loads(definition)
    names = {i: name for name, i in parsed["model"]["vocab"].items()}
    added = {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
    size = max([*names, *added]) + 1
    return [
        bytes(byte_of[c] for c in names[i]) if i in names else added.get(i, b"") for i in range(size)
    ]


class _Grown:
    """An array of whole numbers that grows by doubling."""

    def __init__(self) -> None:
        self.values, self.used = np.zeros(1 << 12, np.int64), 0

    def __len__(self) -> int:
        return self.used

    def extend(self, more: np.ndarray) -> None:
        end = self.used + len(more)
        if end > len(self.values):
            spare = np.zeros(max(end, 2 * len(self.values)) - self.used, np.int64)
            self.values = np.concatenate([self.values[: self.used], spare])
        self.values[self.used : end] = more
        self.used = end


def _strings(parts: pa.Array) -> list[str]:
    return parts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Encodes arrays of texts; ``mode`` is ``spaces`` or ``words`` and must fit the tokenizer."""

    def __init__(self, definition: str, mode: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if mode not in ("spaces", "words"):
            raise ValueError("mode is spaces or words")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mode = mode
        self.glue = "\n" if mode == "spaces" else " 0 "
        self.letters = _byte_letters()
        self.direct = self._takes_letters()
        glue_ids = self._plain([self.glue])[0]
        self.glue_id = glue_ids[0] if len(glue_ids) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {"": 0}
        self.starts, self.sizes = _Grown(), _Grown()
        self.flat = _Grown()
        self._add(np.zeros(0, np.int64), np.zeros(1, np.int64))

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Codes of new parts, whose ids stand one after the other."""
        first = len(self.sizes)
        self.starts.extend(len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.flat.extend(ids)
        return np.arange(first, first + len(sizes))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, one after the other, and where each part ends."""
        sizes = self.sizes.values[codes]
        ends = np.cumsum(sizes)
        shift = self.starts.values[codes] - (ends - sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat.values[np.repeat(shift, sizes) + np.arange(total)], ends

    def _plain(self, texts: list[str]) -> list[list[int]]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in encoded]

    def _merged(self, word: str) -> list[int]:
        """Ids of a word of letters, straight from the model, without normalizer and pre-tokenizer."""
        letters = self.letters
        if not word.isascii():
            word = "".join([letters[b] for b in word.encode()])
        elif word[0] == " ":
            word = letters[32] + word[1:]
        return [token.id for token in self.tokenizer.model.tokenize(word)]

    def _takes_letters(self) -> bool:
        """Whether the model by itself gives words of letters the whole tokenizer's ids."""
        probes = [*_PROBES, *(f" {p}" for p in _PROBES if self.mode == "spaces")]
        return [self._merged(p) for p in probes] == self._plain(probes)

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Codes of distinct new parts: words of letters from the model, many of the others as one
        text with a separator that none of them holds, and the rest one by one."""
        out = np.zeros(len(parts), np.int64)
        left = np.arange(len(parts))
        if self.direct:
            letters = pc.match_substring_regex(parts, _LETTERS[self.mode])
            chosen = letters.to_numpy(zero_copy_only=False)
            out[left[chosen]] = self._add_lists([self._merged(x) for x in _strings(parts.filter(letters))])
            left = left[~chosen]
        rest = parts.take(pa.array(left))
        one = pc.match_substring_regex(rest, _ONE_WORD[self.mode]).to_numpy(zero_copy_only=False)
        if self.glue_id is None:
            one = np.zeros(len(rest), bool)
        names, single = _strings(rest), [left[~one]]
        for at in range(0, int(one.sum()), 4096):
            places = np.flatnonzero(one)[at : at + 4096]
            ids = np.array(self._plain([self.glue.join([names[i] for i in places])])[0], np.int64)
            cuts = np.flatnonzero(ids == self.glue_id)
            if len(cuts) != len(places) - 1:
                single.append(left[places])
                continue
            sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            out[left[places]] = self._add(np.delete(ids, cuts), sizes)
        places = np.concatenate(single)
        out[places] = self._add_lists(self._plain(_strings(parts.take(pa.array(places)))))
        self.codes.update(zip(_strings(parts), out.tolist(), strict=True))
        return out

    def _add_lists(self, own: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return self._add(np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum())), sizes)

    def _known(self, parts: pa.Array) -> np.ndarray:
        """Codes of parts, -1 for new ones."""
        names = _strings(parts)
        return np.fromiter(map(self.codes.get, names, repeat(-1)), np.int64, len(names))

    def _codes_of(self, parts: pa.Array) -> np.ndarray:
        codes = self._known(parts)
        new = np.flatnonzero(codes < 0)
        if not len(new):
            return codes
        fresh = parts.take(pa.array(new))
        cut = pc.match_substring_regex(fresh, _ENDS_IN_STOP)
        cores = pc.if_else(cut, pc.utf8_rtrim(fresh, ".,"), fresh)
        if self.mode == "words":
            cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        tails = pc.if_else(cut, pc.replace_substring_regex(fresh, r"(?s)^.*[^.,]", ""), "")
        # What is a part of its own is new; what was cut or lowered may be known.
        changed = np.flatnonzero(pc.not_equal(cores, fresh).to_numpy(zero_copy_only=False))
        core = np.full(len(fresh), -1)
        core[changed] = self._known(cores.take(pa.array(changed)))
        missing = np.flatnonzero(core < 0)
        if len(missing):
            distinct = cores.take(pa.array(missing)).dictionary_encode()
            core[missing] = self._learn(distinct.dictionary)[distinct.indices.to_numpy(zero_copy_only=False)]
        codes[new] = core
        joined = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        if len(joined):
            ends = tails.take(pa.array(joined)).dictionary_encode()
            tail = self._known(ends.dictionary)
            if (tail < 0).any():
                unknown = np.flatnonzero(tail < 0)
                tail[unknown] = self._learn(ends.dictionary.take(pa.array(unknown)))
            tail = tail[ends.indices.to_numpy(zero_copy_only=False)]
            both = np.stack([core[joined], tail], axis=1).ravel()
            ids, bounds = self._gather(both)
            codes[new[joined]] = self._add(ids, np.diff(bounds[1::2], prepend=0))
        names = _strings(fresh.take(pa.array(changed)))
        self.codes.update(zip(names, codes[new[changed]].tolist(), strict=True))
        return codes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text; NULL counts as empty."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole: dict[int, np.ndarray] = {}
        if self.mode == "spaces":
            unsafe = pc.match_substring_regex(texts, _UNSAFE)
            for at in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)):
                whole[int(at)] = np.array(self._plain([texts[int(at)].as_py()])[0], np.int32)
            texts = pc.if_else(unsafe, pa.scalar("", pa.large_string()), texts)
            parts = pc.split_pattern(texts, " ")
        else:
            parts = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(parts.offsets)
        distinct = parts.values[bounds[0] : bounds[-1]].dictionary_encode()
        bounds = bounds - bounds[0]
        index = distinct.indices.to_numpy(zero_copy_only=False)
        names = distinct.dictionary
        if self.mode == "spaces":
            spaced = pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type))
            codes = self._codes_of(spaced)[index]
            begins = np.unique(bounds[:-1][bounds[:-1] < bounds[1:]])
            firsts = names.take(pa.array(index[begins])).dictionary_encode()
            codes[begins] = self._codes_of(firsts.dictionary)[firsts.indices.to_numpy(zero_copy_only=False)]
        else:
            codes = self._codes_of(names)[index]
        ids, ends = self._gather(codes)
        edges = np.concatenate([[0], ends])[bounds]
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for at, own in whole.items():
            out[at] = own
        return out


def encoder(definition: str, mode: str) -> Encoder:
    """This Python worker's encoder, kept between its tasks."""
    name = "_foldwise_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    key = (hash(definition), mode)
    if key not in kept:
        kept[key] = Encoder(definition, mode)
    return kept[key]


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20):
    """``(first row, texts)`` in slices of bounded size, so that long texts don't pile up."""
    texts = batch.column(column)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size) // most_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(texts)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(a), texts.slice(int(a), int(b - a))
            pa.default_memory_pool().release_unused()
