"""Repetition-coverage quality rules (operator 5).

For each text, rolling hashes of the windows of several lengths in words give
the characters that lie inside repeated windows (first occurrences aside) and
inside repeated lines. A text fails when one of these shares exceeds its
threshold, or when a base rule fails.

Defined cases: a null or empty text has zero counts and fails the base rule;
words are runs of bytes other than space and U+0009 to U+000D; repeated rows
get equal results; extra columns are not read. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import RangeHash, Words, lean, ngram_hashes, text_slices

#: Symbols counted by n_symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
BASE_NGRAM = 5
MAX_BASE_REPEAT_PERCENT = 20
#: Largest allowed percentage of word characters inside windows (of that many words) that repeat an earlier window.
MAX_NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MAX_LINE_CHAR_PERCENT = 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, n_lines long, " + ", ".join(f"repeat_chars_{n} long" for n in MAX_NGRAM_PERCENT)
)


def later_copies(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where an earlier element of the same group has the same key (elements in order)."""
    order = np.lexsort((key, group))
    same = np.zeros(len(key), dtype=bool)
    if len(key) > 1:
        same[1:] = (group[order][1:] == group[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.empty(len(key), dtype=bool)
    out[order] = same
    return out


def copies(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where any other element of the same group has the same key."""
    order = np.lexsort((key, group))
    same = np.zeros(len(key) + 1, dtype=bool)
    if len(key) > 1:
        same[1:-1] = (group[order][1:] == group[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.empty(len(key), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered_words(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the words inside windows of ``n`` words that begin at ``at``."""
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, roll: RangeHash) -> dict[str, np.ndarray]:
    words = Words(data, offsets, roll)
    n_docs, n_words = len(offsets) - 1, len(words.start)
    per_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    chars = begins[words.end] - begins[words.start]
    by_word = lambda values: np.bincount(words.doc, values, minlength=n_docs).astype(np.int64)
    out = {
        "n_words": words.count,
        "word_chars": by_word(chars),
        "n_symbols": per_doc(np.isin(data, np.frombuffer(SYMBOLS, dtype=np.uint8))),
    }
    # lines: split at \n inside each text
    breaks = np.flatnonzero(data == 0x0A)
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((np.concatenate([offsets[:-1], breaks + 1]), doc))
    starts = np.concatenate([offsets[:-1], breaks + 1])[order]
    doc = doc[order]
    ends = np.empty_like(starts)
    last = np.ones(len(starts), dtype=bool)
    if len(starts) > 1:
        last[:-1] = doc[1:] != doc[:-1]
        ends[:-1] = starts[1:] - 1
    ends[last] = offsets[doc[last] + 1]
    has_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, doc = starts[has_word], ends[has_word], doc[has_word]
    dup = later_copies(doc, roll.ranges(data, starts, ends))
    out["n_lines"] = np.bincount(doc, minlength=n_docs).astype(np.int64)
    out["n_dup_lines"] = np.bincount(doc[dup], minlength=n_docs).astype(np.int64)
    word_chars_before = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_chars_before[np.searchsorted(words.start, ends)] - word_chars_before[np.searchsorted(words.start, starts)]
    out["dup_line_chars"] = np.bincount(doc[dup], line_chars[dup], minlength=n_docs).astype(np.int64)
    # windows of words
    for n in sorted({BASE_NGRAM, *MAX_NGRAM_PERCENT}):
        key, at = ngram_hashes(words.hash, words.doc, n)
        if n == BASE_NGRAM:
            out["n_repeat_words"] = by_word(covered_words(at[copies(words.doc[at], key)], n, n_words).astype(np.float64))
        if n in MAX_NGRAM_PERCENT:
            inside = covered_words(at[later_copies(words.doc[at], key)], n, n_words)
            out[f"repeat_chars_{n}"] = by_word(np.where(inside, chars, 0))
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text: words, characters, symbols, repeated lines, characters in repeated windows."""
    names = [field.split()[0] for field in SCHEMA.split(", ")][1:]

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {name: [] for name in names}
            for _, data, offsets in text_slices(batch.column(1)):
                for name, values in measure(data, offsets, roll).items():
                    parts[name].append(values)
            arrays = [pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64)) for v in parts.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of ``repetition`` with base_failed and kept (passes the base rules and every threshold)."""
    counts = repetition(docs, id_col, text_col)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_BASE_REPEAT_PERCENT * F.col("n_words"))
    fails = 100 * F.col("dup_line_chars") > MAX_LINE_CHAR_PERCENT * F.col("word_chars")
    for n, percent in MAX_NGRAM_PERCENT.items():
        fails = fails | (100 * F.col(f"repeat_chars_{n}") > percent * F.col("word_chars"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counts.select(
        *first, base_failed.alias("base_failed"), (~base_failed & ~fails).alias("kept"),
        *[c for c in counts.columns if c not in first],
    )
