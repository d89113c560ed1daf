"""Ranked lexical search by presence masks (operator 13).

One pass over the documents keeps, for each, its number of terms and the
occurrences of the terms that some item asks for; counts over that table give
the statistics of the whole corpus. Then every block of documents becomes one
bitmap a term. For an item, the bitmaps of its terms are written into one mask a document, so documents
with the same matched terms form a group. The largest score that a
mask allows follows from each term's largest weight in the block; groups are
evaluated by falling largest score until the next one cannot reach the item's
twentieth best score of the task any more. Each task's best rows of every item
meet in one ranking.

Items are a query set against all documents: they are taken in blocks of about
``ITEM_BYTES`` bytes of text, one pass over the documents for each, so what travels
to the tasks is bounded.

Scores are exact integers. Terms are found by hash and confirmed on their bytes.

Defined cases: a null or empty text has no terms: it counts nowhere and is
never returned; a row without doc_id counts in the statistics and is never
returned; rows repeated under one doc_id are documents of their own; an item
without terms, or with a null item_id, has no result; repeated rows of an item
count once, and of different texts under one item_id the smallest counts;
terms of weight 0 add nothing; extra columns are not read; an empty table gives
an empty result. Texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.llm.common import LOWER, RangeHash, lean, stored, text_slices

TOP = 20
#: Bytes of item texts whose terms travel to the tasks at once.
ITEM_BYTES = 4 << 20
#: Documents, and occurrences, of one block of bitmaps.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 2_000_000
#: Documents whose scores an item computes first; the next step takes twice as many.
FIRST_STEP = 64

#: Bytes of terms: digits, letters and everything that is not ASCII.
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[0x30:0x3A] = IS_TERM[0x41:0x5B] = IS_TERM[0x61:0x7B] = IS_TERM[0x80:] = True

KEPT = "doc_id long, n long, terms array<int>, counts array<int>"
RESULT = "item_id long, rank int, doc_id long, score long"


def term_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every term of a run of texts."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = IS_TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


class Vocabulary:
    """Distinct terms of some items, found again in texts."""

    def __init__(self, terms: list[bytes]):
        self.size = len(terms)
        self.data = np.frombuffer(b"".join(terms), dtype=np.uint8)
        self.end = np.cumsum([len(t) for t in terms], dtype=np.int64)
        self.start = np.concatenate([[0], self.end[:-1]]) if terms else np.zeros(0, dtype=np.int64)
        seed = 0
        while True:  # a seed under which the terms' hashes differ
            self.hash = RangeHash(seed)
            keys = self.hash.ranges(self.data, self.start, self.end)
            if len(np.unique(keys)) == len(keys):
                break
            seed += 1
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Term number of every range of ``data``, -1 where it is none."""
        out = np.full(len(start), -1, dtype=np.int64)
        if not self.size or not len(start):
            return out
        keys = self.hash.ranges(data, start, end)
        at = np.minimum(np.searchsorted(self.keys, keys), self.size - 1)
        term = self.order[at]
        length = end - start
        hit = np.flatnonzero((self.keys[at] == keys) & (length == self.end[term] - self.start[term]))
        # the bytes themselves decide
        size = length[hit]
        first = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(first[-1]) - np.repeat(first[:-1], size)
        same = data[np.repeat(start[hit], size) + step] == self.data[np.repeat(self.start[term[hit]], size) + step]
        wrong = np.unique(np.repeat(np.arange(len(hit)), size)[~same])
        hit = np.delete(hit, wrong)
        out[hit] = term[hit]
        return out


def item_terms(items: list[tuple[int, str]]) -> tuple[list[bytes], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Distinct terms of some items; (item, its terms, their occurrences) of each item that has any."""
    number: dict[bytes, int] = {}
    out = []
    for item, text in items:
        data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
        _, start, end = term_places(data, np.array([0, len(data)]))
        if len(start):
            found = [number.setdefault(data[a:b].tobytes(), len(number)) for a, b in zip(start.tolist(), end.tolist())]
            out.append((item, *np.unique(np.array(found), return_counts=True)))
    return list(number), out


def matched_terms(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, number of terms, and the vocabulary's terms with their occurrences, of every document."""

    def run(batches):
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column(1)):
                data = LOWER[data]
                doc, start, end = term_places(data, offsets)
                n_docs = len(offsets) - 1
                total = np.bincount(doc, minlength=n_docs).astype(np.int64)
                term = vocabulary.find(data, start, end)
                code, count = np.unique(doc[term >= 0] * vocabulary.size + term[term >= 0], return_counts=True)
                owner = code // max(vocabulary.size, 1)
                cuts = pa.array(np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32))
                terms = pa.ListArray.from_arrays(cuts, pa.array((code - owner * vocabulary.size).astype(np.int32)))
                counts = pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n_docs), pa.array(total), terms, counts], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), KEPT)


def document_frequencies(kept: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    parts = kept.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in parts.collect():  # one row a term of the block of items
        out[term] = df
    return out


class Best:
    """The best rows of one item so far: higher score first, then smaller document."""

    def __init__(self, top: int):
        self.top = top
        self.score = np.zeros(0, dtype=np.int64)
        self.doc = np.zeros(0, dtype=np.int64)

    def least(self) -> int:
        """Scores below this cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least()
        score, doc = np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
        order = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[order], doc[order]


def presence_groups(bitmaps: list[np.ndarray], n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with a matched term, ordered by mask; where each distinct mask begins; the masks (groups x terms, boolean)."""
    words = (len(bitmaps) + 63) // 64
    mask = np.zeros((n_docs, words), dtype=np.uint64)
    for t, docs in enumerate(bitmaps):
        mask[docs, t >> 6] |= np.uint64(1 << (t & 63))
    present = np.flatnonzero(mask.any(axis=1))
    mask = mask[present]
    order = np.lexsort(mask.T)
    mask = mask[order]
    new = np.ones(len(mask), dtype=bool)
    new[1:] = (mask[1:] != mask[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    bits = (mask[first][:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return present[order], first, bits.reshape(len(first), -1)[:, : len(bitmaps)].astype(bool)


def search_block(items, weight, doc_id, terms, cuts, part, best) -> None:
    """Add one block of documents to the items' best rows.

    ``terms``, ``part``: a term and its share of the score for every occurrence,
    document by document as ``cuts`` tells.
    """
    n_docs = len(doc_id)
    owner = np.repeat(np.arange(n_docs), np.diff(cuts))
    order = np.argsort(terms, kind="stable")
    owner, part = owner[order], part[order]
    size = len(weight)
    begin = np.searchsorted(terms[order], np.arange(size + 1))
    filled = np.flatnonzero(begin[1:] > begin[:-1])
    largest = np.zeros(size, dtype=np.int64)
    if len(filled):
        largest[filled] = np.maximum.reduceat(part, begin[filled])
    for item, asked, times in items:
        use = weight[asked] * largest[asked] > 0
        asked, factor = asked[use], (times * weight[asked])[use]
        if not len(asked):
            continue
        held = best[item]
        if int(factor @ largest[asked]) < held.least():
            continue
        docs, first, masks = presence_groups([owner[begin[t] : begin[t + 1]] for t in asked], n_docs)
        bound = masks @ (factor * largest[asked])
        sizes = np.diff(np.concatenate([first, [len(docs)]]))
        ranked = np.argsort(-bound, kind="stable")
        before = np.concatenate([[0], np.cumsum(sizes[ranked])])
        done, step = 0, FIRST_STEP
        while done < len(ranked) and bound[ranked[done]] >= held.least():
            stop = max(done + 1, int(np.searchsorted(before, before[done] + step, side="right")) - 1)
            groups = ranked[done:stop]
            groups = groups[bound[groups] >= held.least()]
            inside = np.concatenate([docs[first[g] : first[g] + sizes[g]] for g in groups])
            inside.sort()
            score = np.zeros(len(inside), dtype=np.int64)
            for t, f in zip(asked.tolist(), factor.tolist()):
                lo, hi = begin[t], begin[t + 1]
                at = lo + np.minimum(np.searchsorted(owner[lo:hi], inside), hi - lo - 1)
                score += np.where(owner[at] == inside, f * part[at], 0)
            held.add(score, doc_id[inside])
            done, step = stop, step * 2


def search_items(kept: DataFrame, items, vocabulary_size: int, documents: int, occurrences: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best rows of every item in every task."""
    df = document_frequencies(kept, vocabulary_size)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)

    def run(batches):
        best = {item: Best(top) for item, _, _ in items}
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda k: table.column(k).combine_chunks()
            lists = column(2)
            cuts = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()).astype(np.int64))])
            terms, tf = lists.flatten().to_numpy().astype(np.int64), column(3).flatten().to_numpy().astype(np.int64)
            m = 100 - 25 + (25 * table.column(1).to_numpy() * documents) // occurrences
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(cuts)))
            search_block(items, weight, table.column(0).to_numpy(), terms, cuts, part, best)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):  # bounded runs of rows
                part = batch.slice(lo, 1024)
                held.append(part)
                docs += part.num_rows
                postings += len(part.column(2).flatten())
                if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    block()
                    held, docs, postings = [], 0, 0
        if docs:
            block()
        found = [(item, b) for item, b in best.items() if len(b.score)]
        if found:
            columns = [
                np.repeat([item for item, _ in found], [len(b.score) for _, b in found]),
                np.concatenate([b.doc for _, b in found]), np.concatenate([b.score for _, b in found]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "doc_id", "score"])

    some = kept.where("doc_id is not null and size(terms) > 0")
    return some.mapInArrow(lean(run), "item_id long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, *, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id and score of every item's ``top`` best documents."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    asked = stored(asked.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text")), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // item_bytes)
    rows, totals = None, None
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        terms, listed = item_terms([(r["item_id"], r["text"]) for r in mine.collect()])  # about item_bytes of text
        if not listed:
            continue
        kept = stored(matched_terms(docs, Vocabulary(terms), id_col, text_col), "matched")
        totals = totals or kept.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
        if totals["terms"]:
            found = search_items(kept, listed, len(terms), totals["docs"], totals["terms"], top)
            rows = found if rows is None else rows.union(found)
    if rows is None:
        return spark.createDataFrame([], RESULT)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return rows.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= top)
