"""Quality classifier: regularised quadratic discriminant (operator 8).

Each text becomes a fixed vector of transformed statistics. Each class has a
mean and a covariance; the covariance is shrunk toward the pooled one and
toward its diagonal, and factored once (Cholesky). A text's score is the
logistic of the difference of the classes' Gaussian log densities and log
shares. Class sums come from all learning rows, added up per task.

Defined cases: null counts as the empty text, which has a finite score like
any other; labels other than 0 and 1 and labels of unknown rows are left out; a doc_id with both labels
counts as 0, whatever the order of its label rows;
rows repeated under one id get equal scores; when a class has no learning row,
every score is the share of label 1 (0.5 without any row); an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import LOWER, RangeHash, Words, lean, ngram_hashes, stored, text_slices
from flowdetect.llm.quality_rules import copies, later_copies

THRESHOLD = 0.7
#: Weights of the pooled covariance and of the diagonal in each class covariance.
TO_POOLED = 0.2
TO_DIAGONAL = 0.1
#: Held-out rows: crc32 of the id as text, modulo 4.
HELD_OUT_REMAINDER = 2
#: Words at which a text's deviations count half: the shares of a very short text say little.
HALF_WEIGHT_WORDS = 15
#: Standardised statistics are limited to this many deviations.
LIMIT = 6.0

STATISTICS = [
    "word_length", "symbols", "upper", "bangs", "digits", "stops", "commas", "short_words",
    "distinct_words", "repeated_next", "repeated_windows", "repeated_words", "top_word", "capital_words",
    "marked_words", "pipes", "repeated_lines", "wide_letters", "weight",
]


def _byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


UPPER = _byte_set(bytes(range(65, 91)))
LETTER = _byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))
SYMBOL = _byte_set(b"#*$%&<>@^~=+_\\/{}[]")
DIGIT = _byte_set(b"0123456789")


def statistics(data: np.ndarray, offsets: np.ndarray, roll: RangeHash) -> np.ndarray:
    """One row of transformed statistics per text, and in the last column the weight of its deviations."""
    n_docs = len(offsets) - 1
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(np.float64)
    words = Words(LOWER[data], offsets, roll)
    doc, n_words = words.doc, words.count.astype(np.float64)
    of_words = lambda values: np.bincount(doc, values, minlength=n_docs)
    chars = count((data & 0xC0) != 0x80)
    per_char, per_word = np.maximum(chars, 1), np.maximum(n_words, 1)
    letters = np.maximum(count(LETTER[data]), 1)
    length = (words.end - words.start).astype(np.float64)
    later = later_copies(doc, words.hash)
    next_same = np.zeros(len(doc), dtype=bool)
    if len(doc) > 1:
        next_same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    key, at = ngram_hashes(words.hash, doc, 3)
    windows = np.maximum(np.bincount(doc[at], minlength=n_docs), 1)
    repeated_windows = np.bincount(doc[at], copies(doc[at], key), minlength=n_docs) / windows
    order = np.lexsort((words.hash, doc))
    top = np.zeros(n_docs)
    if len(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        begin = np.flatnonzero(new)
        np.maximum.at(top, doc[order][begin], np.diff(np.append(begin, len(order))).astype(np.float64))
    first_byte, last_byte = data[words.start] if len(doc) else data[:0], data[words.end - 1] if len(doc) else data[:0]
    # lines, by the hash of all their bytes
    breaks = np.flatnonzero(data == 0x0A)
    ends = np.concatenate([offsets[1:], breaks])
    line_doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, side="right") - 1])
    by_end = np.lexsort((ends, line_doc))
    ends, line_doc = ends[by_end], line_doc[by_end]
    starts = offsets[line_doc].copy()
    if len(ends) > 1:
        inner = line_doc[1:] == line_doc[:-1]
        starts[1:][inner] = ends[:-1][inner] + 1
    full = ends - starts > 1
    again = later_copies(line_doc[full], roll.ranges(data, starts[full], ends[full]))
    repeated_lines = np.bincount(line_doc[full], again, minlength=n_docs) / np.maximum(np.bincount(line_doc[full], minlength=n_docs), 1)
    root = np.sqrt
    return np.column_stack([
        np.log1p(of_words(length) / per_word),
        root(count(SYMBOL[data]) / per_char),
        root(count(UPPER[data]) / letters),
        root(count(data == 0x21) / per_word),
        root(count(DIGIT[data]) / per_char),
        root(count(data == 0x2E) / per_word),
        root(count(data == 0x2C) / per_word),
        of_words(length <= 3) / per_word,
        np.log1p(of_words(~later)) / np.log1p(per_word),
        root(of_words(next_same) / per_word),
        root(repeated_windows),
        of_words(later) / per_word,
        root(top / per_word),
        root(of_words(UPPER[first_byte]) / per_word),
        root(of_words(~(LETTER | DIGIT)[last_byte] & (last_byte < 0x80)) / per_word),
        root(count(data == 0x7C) / per_word),
        root(repeated_lines),
        count(data >= 0xC0) / per_char,
        n_words / (n_words + HALF_WEIGHT_WORDS),
    ])


def _vectors(column: pa.Array, roll: RangeHash) -> np.ndarray:
    parts = [statistics(data, offsets, roll) for _, data, offsets in text_slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats): the statistics of every text."""

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            values = _vectors(batch.column(1), roll)
            flat = pa.array(values.ravel())
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, stats array<double>")


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == HELD_OUT_REMAINDER


def deviations(stats: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics, limited, times each text's weight."""
    return np.clip((stats[:, :-1] - center) / scale, -LIMIT, LIMIT) * stats[:, -1:]


@dataclass
class Discriminant:
    """The fitted classes: scores standardised statistics."""

    center: np.ndarray
    scale: np.ndarray
    mean: list[np.ndarray]
    inverse: list[np.ndarray]  # inverse of each class's Cholesky factor
    constant: list[float]
    share: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(stats), self.share)
        x = deviations(stats, self.center, self.scale)
        density = [
            c - 0.5 * np.square((x - m) @ inv.T).sum(axis=1) for c, m, inv in zip(self.constant, self.mean, self.inverse)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def _sums(rows: DataFrame, moments) -> dict[int, np.ndarray]:
    """Column sums per class of ``moments(stats)``: one row per task and class is added up by Spark."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            label = batch.column(0).to_numpy()
            for k in (0, 1):
                if (label == k).any():
                    total[k] = total.get(k, 0) + moments(values[label == k])
        if total:
            flat = np.concatenate([total[k] for k in total])
            sizes = [len(total[k]) for k in total]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(total), sizes)), pa.array(np.concatenate([np.arange(n) for n in sizes])), pa.array(flat)],
                ["label", "k", "value"],
            )

    added = rows.mapInArrow(lean(run), "label long, k long, value double").groupBy("label", "k").agg(F.sum("value").alias("value")).collect()
    out: dict[int, np.ndarray] = {}
    for row in sorted(added, key=lambda r: (r["label"], r["k"])):
        out.setdefault(row["label"], []).append(row["value"])
    return {k: np.array(v) for k, v in out.items()}


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on every labelled row that is not held out (all rows: two passes over the small statistics)."""
    wanted = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    rows = stored(stats.join(wanted, "doc_id").select("label", "stats"), "labelled")
    d = len(STATISTICS) - 1
    plain = _sums(rows, lambda x: np.concatenate([[len(x)], x[:, :-1].sum(0), np.square(x[:, :-1]).sum(0)]))
    counts = {k: v[0] for k, v in plain.items()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Discriminant(np.zeros(d), np.ones(d), [], [], [], share)
    added = sum(plain.values())
    center = added[1 : d + 1] / total
    scale = np.sqrt(np.maximum(added[d + 1 :] / total - center**2, 0)) + 1e-3

    def second(x: np.ndarray) -> np.ndarray:
        z = deviations(x, center, scale)
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    sums = _sums(rows, second)
    mean = [sums[k][:d] / counts[k] for k in (0, 1)]
    cov = [sums[k][d:].reshape(d, d) / counts[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = sum(counts[k] * cov[k] for k in (0, 1)) / total
    inverse, constant = [], []
    for k in (0, 1):
        shrunk = (1 - TO_POOLED) * cov[k] + TO_POOLED * pooled
        shrunk = (1 - TO_DIAGONAL) * shrunk + TO_DIAGONAL * np.diag(np.diag(shrunk)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        constant.append(float(np.log(counts[k] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(center, scale, mean, inverse, constant, share)


def score_statistics(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted from stored statistics."""

    def run(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(values))], ["doc_id", "score"])

    scored = stats.mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted_rows(docs: DataFrame, model: Discriminant, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least THRESHOLD, with their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            yield batch.filter(pa.array(model.score(_vectors(batch.column(at), roll)) >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score of every row of ``docs``, learned from ``labels``."""
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    return score_statistics(stats, fit(stats, labels, id_col, label_col))
