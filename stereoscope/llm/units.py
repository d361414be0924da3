"""Cuts text where byte-level BPE tokenizers cut it anyway, so encodings of short units can be kept.

The pattern of these vocabularies starts a new piece at every U+0020 that is followed by a
non-white-space character, and it never looks back. So a text's ids are the ids of its units, one after
the other, where a unit reaches from one such blank to just before the next. A line feed with no white
space beside it is a piece of its own, so it parts units too. Characters on which regular expression
engines disagree count as white space here: then no cut is made, which is always right.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# white space that is not alone between two other characters: then only blanks before words part units
CROWDED = re.compile(r"\s(?:\s|\Z)|\A\s")
CUT = re.compile(r"(?= \S)")
# the same as CROWDED, for Arrow's regular expressions: they know no white space beyond ASCII, so it is listed
SPACE = "[" + "".join(f"\\x{{{k:x}}}" for k in range(0x3001) if chr(k).isspace()) + "]"
CROWDED_ARROW = rf"{SPACE}{SPACE}|\A{SPACE}|{SPACE}\z"
MARK = "\x00"  # stands between units; a text that holds it is cut the other way
# letters of the Latin blocks, then ASCII marks: two pieces that need no general pattern
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\\[-`{-~]*)")


def units(text: str) -> list[str]:
    """The units of ``text``, in order; joined they are ``text``."""
    if CROWDED.search(text):
        return CUT.split(text)
    out: list[str] = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out += ["\n", first] if out else [first]
        out += [" " + p for p in rest]
    return out


class UnitCache(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers.

    ``encode`` makes the ids of any text, ``encode_piece`` those of a text that is one piece of the
    pattern. Long units are not kept. There are two generations of at most ``entries`` units: a full
    young one becomes the old one, and units met again move back. So memory stays bounded whatever the
    corpus holds, and frequent units stay.
    """

    def __init__(self, encode, encode_piece, entries: int = 250_000, longest: int = 40):
        super().__init__()
        self.encode, self.encode_piece, self.entries, self.longest = encode, encode_piece, entries, longest
        self.old: dict[str, bytes] = {}
        self.blank = _AfterBlank(self)

    def _age(self, young: dict) -> dict:
        old = dict(young)
        young.clear()
        return old

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            plain = PLAIN.fullmatch(unit)
            if not plain:
                ids = self.encode(unit)
            elif not plain[2]:
                ids = self.encode_piece(unit)
            else:
                ids = self[plain[1]] + self[plain[2]]
        if len(unit) <= self.longest:
            if len(self) >= self.entries:
                self.old = self._age(self)
            self[unit] = ids
        return ids

    def text(self, text: str) -> bytes:
        """All ids of the text."""
        if CROWDED.search(text):
            return b"".join(map(self.__getitem__, CUT.split(text)))
        return self["\n"].join(map(self._line, text.split("\n")))

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self[first] + b"".join(map(self.blank.__getitem__, rest)) if rest else self[first]


class _AfterBlank(dict):
    """The same for units that begin with a blank, by what follows the blank."""

    def __init__(self, all_units: UnitCache):
        super().__init__()
        self.all, self.old = all_units, {}

    def __missing__(self, rest: str) -> bytes:
        ids = self.old.get(rest)
        if ids is None:
            unit = " " + rest
            plain = PLAIN.fullmatch(unit)
            if plain and plain[2]:
                ids = self[plain[1][1:]] + self.all[plain[2]]
            elif plain:
                ids = self.all.encode_piece(unit)
            else:
                ids = self.all.encode(unit)
        if len(rest) < self.all.longest:
            if len(self) >= self.all.entries:
                self.old = self.all._age(self)
            self[rest] = ids
        return ids


class BatchCache(UnitCache):
    """The same for many texts at once, whose units have a table of their own: ids lie one after the other in an array.

    ``encode_pieces`` makes the ids of many texts that are one piece each. A table that is full starts anew with the
    next texts; a frequent unit is then encoded once more.
    """

    def __init__(self, encode, encode_pieces, entries: int = 250_000, longest: int = 40):
        super().__init__(encode, lambda piece: np.array(encode_pieces([piece])[0], "<u4").tobytes(), entries, longest)
        self.encode_pieces = encode_pieces
        self._anew()

    def _anew(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size, self.start = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _put(self, units: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(units, range(len(self.size), len(self.size) + len(units))))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))

    def _numbers(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units with these numbers, one after the other, and where each unit's end."""
        n = self.size[numbers]
        ends = np.cumsum(n)
        at = np.repeat((self.start[numbers] - (ends - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], ends

    def _add(self, units: list[str]) -> None:
        """Take units that are not in the table into it."""
        pieces, others, made, parts = [], [], [], []
        for u in units:
            if u.isascii() and (u[1:] if u[0:1] == " " else u).isalpha():  # most units, without the pattern's cost
                pieces.append(u)
            elif not (plain := PLAIN.fullmatch(u)):
                others.append(u)
            elif plain[2]:
                made.append(u)
                parts += plain.groups()
            else:
                pieces.append(u)
        known = self.number
        pieces = list(dict.fromkeys(pieces + [p for p in parts[::2] if p not in known]))
        ids = self.encode_pieces(pieces)
        self._put(pieces, np.array(list(chain.from_iterable(ids)), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)))
        others = list(dict.fromkeys(others + [p for p in parts[1::2] if p not in known]))
        packed = list(map(self.encode, others))
        self._put(others, np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
        ids, ends = self._ids(self._numbers(parts))
        self._put(made, ids, np.diff(ends[1::2], prepend=0))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has.

        Texts are cut by Arrow and each different unit among them is looked up once; ids are then gathered by the units' numbers.
        """
        if len(self.size) >= self.entries or len(self.ids) >= 8 * self.entries:
            self._anew()
        texts = texts.cast(pa.large_string())  # marks make a text longer
        odd = pc.or_(pc.match_substring_regex(texts, CROWDED_ARROW), pc.match_substring(texts, MARK))
        plain = pc.if_else(odd, "", texts)
        marked = pc.replace_substring(pc.replace_substring(plain, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        cut = pc.split_pattern(marked, MARK)
        coded = cut.flatten().dictionary_encode()
        each = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.number.get, each, repeat(-1)), np.int64, len(each))
        new = np.flatnonzero(number < 0)
        unseen = [each[k] for k in new.tolist()]
        self._add(unseen)
        number[new] = self._numbers(unseen)
        out, ends = self._ids(number[coded.indices.to_numpy(zero_copy_only=False)])
        bounds = np.concatenate(([0], ends))[cut.offsets.to_numpy(zero_copy_only=False)]
        counts = np.diff(bounds)
        parts, done = [], 0
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            own = np.frombuffer(b"".join(map(self.__getitem__, units(texts[k].as_py()))), dtype="<u4")
            parts += [out[done:bounds[k]], own]
            done, counts[k] = bounds[k], len(own)
        return (np.concatenate([*parts, out[done:]]) if parts else out), counts
