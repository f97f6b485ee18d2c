"""Whole-text token ids in bulk, by the `tokenizers` library.

White space splits a text into units that the vocabularies encode independently of each other. A slice of texts is
encoded by its distinct units only: Arrow finds them, the library encodes those that the worker has not met before, and
the ids of the texts are gathered from that table. Strings of special tokens in a text are ordinary text, or, with
`specials`, the tokens themselves, as a tokenizer does that is used as loaded; such texts are encoded whole.
"""

from __future__ import annotations

import re
import sys
import types
from itertools import chain, repeat

import numpy as np

RARE = re.compile(r"[^\S \n]|" + "\x02")
EDGE = re.compile(r"(?<=\S) (?=\S)")
MARK = "\x02"
#: Between these both vocabularies always cut, so what follows a word is a unit of its own.
EDGE_OF_WORD = r"([A-Za-z0-9À-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
MOST_UNITS, MOST_IDS = 1_000_000, 8_000_000  # kept by a worker; beyond either it starts anew with the next slice


def gather(index: np.ndarray, starts: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[starts[i]:starts[i]+lens[i]] for every i of index, one after the other."""
    n = lens[index]
    total = int(n.sum())
    first = np.cumsum(n) - n
    return flat[np.repeat(starts[index] - first, n) + np.arange(total)]


def _distinct(lists):
    """Of an Arrow array of lists of strings: each item's place among the distinct ones, these, and the lists' lengths."""
    import pyarrow.compute as pc

    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def shared(kind: type, path: str, specials: bool = False):
    """The coder of a worker process for a vocabulary. Later tasks find it again in a module of the worker's own, while
    this module is sent anew with every task."""
    kept = sys.modules.setdefault("_ravelin_worker", types.ModuleType("_ravelin_worker")).__dict__
    key = f"{kind.__name__} {specials} {path}"
    if key not in kept:
        kept[key] = kind(path, specials)
    return kept[key]


class Units:
    """Ids of units by the library. Those of units met before are kept in one array."""

    def __init__(self, path: str, specials: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        own = [t.content for t in self.library.get_added_tokens_decoder().values()] if specials else []
        self.special = re.compile("|".join(map(re.escape, own))) if own else None
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.size, self.flat = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def find(self, keys: list[str], name) -> np.ndarray:
        """The places in start and size of the units name(key)."""
        place = np.fromiter(map(self.place.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        if len(unknown := np.flatnonzero(place < 0)):
            fresh = dict.fromkeys(keys[i] for i in unknown.tolist())
            ids = [e.ids for e in self.library.encode_batch_fast([name(k) for k in fresh], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum()))
            self.place.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            place[unknown] = np.fromiter(map(self.place.__getitem__, map(keys.__getitem__, unknown.tolist())), dtype=np.int64, count=len(unknown))
        return place

    def encode(self, lists, name, apart: dict[int, list[str] | str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text. lists: the units of each text (Arrow) by a key,
        of which name makes the unit. apart: texts that are empty there, by keys of their own or, as a string, whole."""
        if len(self.place) > MOST_UNITS or len(self.flat) > MOST_IDS:
            self.clear()
        index, keys, counts = _distinct(lists)
        own = {i: u for i, u in apart.items() if not isinstance(u, str)}
        place = self.find(keys + [u for units in own.values() for u in units], name)
        starts, lens = self.start[place], self.size[place]
        odd, at = {i: self.whole(u) for i, u in apart.items() if isinstance(u, str)}, len(keys)
        for i, units in own.items():
            odd[i] = gather(np.arange(at, at + len(units)), starts, lens, self.flat)
            at += len(units)
        return _assemble(index, counts, self.flat, lens, odd, starts)


class BytePairs:
    """Byte-level BPE whose pieces may start with a space (byte_bpe_50k)."""

    def __init__(self, path: str, specials: bool = False):
        self.units = Units(path, specials)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        marked, apart = [""] * len(texts), {}
        for i, text in enumerate(texts):
            flat = text.replace("\n", " ")
            if self.units.special and self.units.special.search(text):
                apart[i] = text
            elif RARE.search(text) or "  " in flat or flat[:1] == " " or flat[-1:] == " ":
                # runs of white space, and white space at the ends: cut only at a blank between two other characters
                apart[i] = [u if k and u[0] != MARK else MARK + " " * (k > 0) + u for k, u in enumerate(EDGE.split(text))]
            elif text:
                marked[i] = MARK + text.replace("\n", " \n " + MARK)
        cut = pc.replace_substring_regex(pa.array(marked, type=pa.large_string()), EDGE_OF_WORD, rf"\1 {MARK}\2")
        return self.units.encode(pc.split_pattern(cut, " "), self._unit, apart)

    @staticmethod
    def _unit(key: str) -> str:
        """A key is a word that follows a blank, a line feed or, behind a MARK, the unit itself."""
        return key and (key if key == "\n" else key[1:] if key[0] == MARK else " " + key)


class WordPairs:
    """BPE with word ends, lower case, white space dropped (word_bpe_49k)."""

    def __init__(self, path: str, specials: bool = False):
        self.units = Units(path, specials)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        special = self.units.special  # in lower case
        apart = {i: t for i, t in enumerate(texts) if special.search(t.lower())} if special else {}
        plain = ["" if i in apart else t for i, t in enumerate(texts)] if apart else texts
        cut = pc.replace_substring_regex(pc.ascii_lower(pa.array(plain, type=pa.large_string())), EDGE_OF_WORD, r"\1 \2")
        return self.units.encode(pc.ascii_split_whitespace(cut), lambda u: u, apart)


def _assemble(index, counts, flat, lens, odd, starts):
    ids = gather(index, starts, lens, flat) if len(index) else np.zeros(0, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(lens[index])]) if len(index) else np.zeros(1, dtype=np.int64)
    upto = np.cumsum(counts)
    n = ends[upto] - ends[upto - counts]
    if odd:  # rare: put whole encodings between the others
        cut, parts, at = ends[upto], [], 0
        for i in sorted(odd):
            here = int(cut[i])
            parts += [ids[at:here], odd[i]]
            at, n[i] = here, len(odd[i])
        ids = np.concatenate([*parts, ids[at:]])
    return ids, n
