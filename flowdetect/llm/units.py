"""Texts as codes of distinct units (words with their white space), each unit encoded once."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from flowdetect.llm.common import IS_SPACE, LOWER

#: Distinct units a task remembers before it starts afresh (bounds its memory).
MAX_UNITS = 300_000
#: Bytes of text whose units are listed at once: longer runs repeat more units.
UNIT_SLICE = 4 << 20
#: Units encoded as one string, with a mark between them.
RUN = 2000


class UnitEncoder:
    """Token ids of units, many at a time.

    Units are joined by ``mark``, a piece of text that the tokenizer always
    turns into the one id ``mark_id`` and that cuts the text on both sides, so
    each unit gets the ids it has alone. A unit that holds the mark is encoded
    by itself.
    """

    def __init__(self, tokenizer_json: str, mark: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = mark
        (self.mark_id,) = self._ids([mark])[0]
        self.special = [t["content"].encode() for t in json.loads(tokenizer_json)["added_tokens"]]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _between(runs, mark_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids without the marks, and the number of ids before, between and after the marks of each run."""
        flat, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for run in runs:
            ids = np.array(run, dtype=np.int64)
            marks = np.flatnonzero(ids == mark_id)
            counts.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            flat.append(np.delete(ids, marks))
        return np.concatenate(flat), np.concatenate(counts)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each unit)."""
        core = self.mark.strip()
        odd = [i for i, u in enumerate(units) if core in u]
        plain = units
        if odd:
            plain = list(units)
            for i in odd:
                plain[i] = ""
        texts = (self.mark.join(plain[k : k + RUN]) for k in range(0, len(plain), RUN))
        ids, lengths = self._between((self._ids([text])[0] for text in texts), self.mark_id)
        if odd:
            at, parts = np.concatenate([[0], np.cumsum(lengths)]), []
            previous = 0
            for i, own in zip(odd, self._ids([units[i] for i in odd])):
                parts += [ids[previous : at[i]], np.array(own, dtype=np.int64)]
                previous, lengths[i] = at[i], len(own)
            ids = np.concatenate([*parts, ids[previous:]])
        return ids, lengths


class LowerUnitEncoder(UnitEncoder):
    """For the units of ``lower_units``: runs of the letters a to z go to the merges at once.

    Such a run is one piece that normalizing and splitting leave as it is, and
    in a byte-level vocabulary its letters stand for themselves.
    """

    def __init__(self, tokenizer_json: str, mark: str):
        super().__init__(tokenizer_json, mark)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.sign = " ! "
        (self.sign_id,) = self.merges.encode_batch_fast([self.sign], add_special_tokens=False)[0].ids

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.fromiter((u.isascii() and u.isalpha() and u.islower() for u in units), dtype=bool, count=len(units))
        runs = [u for u, own in zip(units, letters.tolist()) if own]
        others = super().encode([u for u, own in zip(units, letters.tolist()) if not own])
        texts = (self.sign.join(runs[k : k + RUN]) for k in range(0, len(runs), RUN))
        found = self._between((self.merges.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts), self.sign_id)
        ids, lengths = (np.concatenate([a, b]) for a, b in zip(found, others))
        order = np.empty(len(units), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])] = np.arange(len(units))
        return flat_take(ids, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), order)


class UnitTable:
    """Codes and token ids of the distinct units that a task has seen."""

    def __init__(self, encoder: UnitEncoder):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int64)
        self.offsets = np.zeros(1, dtype=np.int64)

    def codes(self, units: list[str]) -> np.ndarray:
        """Code of each of some distinct units; new ones are encoded. Codes hold until the next call."""
        if len(self.code) > MAX_UNITS:
            self.clear()
        code = self.code
        new = [u for u in units if u not in code]
        if new:
            ids, lengths = self.encoder.encode(new)
            code.update(zip(new, range(len(code), len(code) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        return np.fromiter(map(code.__getitem__, units), dtype=np.int64, count=len(units))


def flat_take(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[offsets[c]:offsets[c + 1]] for each code, one after another, and their lengths."""
    counts = offsets[codes + 1] - offsets[codes]
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(offsets[codes], counts)
    return values[at], counts


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """String array of byte ranges that follow one another without gaps inside ``data``."""
    offsets = np.append(starts, ends[-1] if len(ends) else 0).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def distinct(units: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Index of each unit into the list of distinct units."""
    coded = pc.dictionary_encode(units)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


#: Mark for tokenizers that drop white space: a number sign that is a piece of its own.
SPACE_MARK = " \u00bd "


def _classes() -> np.ndarray:
    """Class of each byte: white space, letter, digit, sign, or 4 for the apostrophe and bytes beyond ASCII."""
    table = np.full(256, 4, dtype=np.int8)
    table[33:127] = 3
    for lo, hi, kind in ((65, 91, 1), (97, 123, 1), (48, 58, 2)):
        table[lo:hi] = kind
    table[ord("'")] = 4
    table[IS_SPACE] = 0
    return table


CLASS = _classes()


def lower_units(data: np.ndarray, offsets: np.ndarray, table: UnitTable) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the units of some texts, and the number of units of each text.

    For tokenizers that lower the case, drop white space and split letters,
    digits and signs: a unit is a run of ASCII letters, digits or signs. An
    apostrophe (it may join letters) or a character beyond ASCII (it may be of any kind)
    never borders a unit, except at white space; nor do units begin or end inside the special tokens, whose texts are cut at
    white space alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets) - 1, dtype=np.int64)
    kind = CLASS[data]
    text = data.tobytes()
    if any(mark in text for mark in table.encoder.special):
        kind = np.minimum(kind, 1)  # words as they are
        lower = data
    else:
        lower = LOWER[data]
    begin = np.zeros(n + 1, dtype=bool)
    begin[1:n] = (kind[1:] != kind[:-1]) & ((kind[:-1] == 0) | (kind[1:] != 4) & (kind[:-1] != 4))
    begin[offsets] = True
    inside = kind != 0
    begin = begin[:n] & inside
    rank = np.cumsum(inside)
    starts = rank[begin] - 1
    index, units = distinct(cut(lower[inside], starts, np.append(starts[1:], rank[-1]))) if len(starts) else (starts, [])
    per_doc = np.diff(np.concatenate([[0], np.cumsum(begin)])[offsets])
    return table.codes(units)[index], per_doc


def may_be_space_end(data: np.ndarray) -> np.ndarray:
    """True at bytes that may end a white-space character of any kind (some other characters too)."""
    before = np.concatenate([np.zeros(1, dtype=np.uint8), data[:-1]]) if len(data) else data
    two = before.astype(np.uint16) << 8 | data
    wide = np.isin(two, WIDE_SPACE_ENDS)
    return IS_SPACE[data] | (data < 0x20) | wide


#: Last two UTF-8 bytes of the white-space characters beyond ASCII.
WIDE_SPACE_ENDS = np.array(
    [0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F], dtype=np.uint16
)


def leading_space_units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units that a byte-level tokenizer encodes independently.

    A unit begins where white space follows something else: no piece of such a
    tokenizer has white space after other characters, and none looks back.
    """
    n = len(data)
    begin = np.zeros(n + 1, dtype=bool)
    if n:
        begin[1:n] = IS_SPACE[data[1:]] & ~may_be_space_end(data)[:-1]
    begin[offsets] = True
    return np.flatnonzero(begin[:n])
