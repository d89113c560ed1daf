"""Removal of repeated byte strings by a depth-limited radix sort of suffixes (operator 10).

A byte is removed when a string of LENGTH bytes covers it that also starts
earlier (a smaller id, or the same document further ahead). Only the first
LENGTH bytes of a suffix matter, so suffixes are ordered to that depth and
groups that are equal there are exactly the repeated strings.

The first radix digit is an anchor: of the GRAM-byte pieces inside a string of LENGTH
bytes, the one with the least hash. Equal strings have equal anchors at equal
places, and neighbouring strings share anchors, so a text of n bytes has about
n / 35 of them. Suffixes whose anchor occurs once are done. The others travel with
their bytes and are ordered by passes over eight bytes at a time, most
significant first; what is alone after a pass is done. Anchors that occur very often
are ordered by digests of their strings with Spark's partial aggregation instead, so no
anchor is one task's work.

Defined cases: null counts as empty; texts below LENGTH bytes lose nothing;
a null id comes after all others; rows of one id are ordered by the checksum of their
texts, and equal rows of one id are one document, so neither removes the other;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import RollingHash, as_long, lean, slices, stored, text_buffer
from flowdetect.session import remove_path, scratch_path

LENGTH = 100
GRAM = 32
#: Strings handled by one numpy pass over a text; longer texts take several.
CHUNK = 4 << 20
#: Occurrences of one anchor that a task orders itself.
MANY = 4096
#: Strings ordered at a time.
SORT_ROWS = 60_000
LAST = (1 << 63) - 1

ANCHORS = "hash long, id long, tag long, lo long, shape int"


def anchors(data: np.ndarray, offsets: np.ndarray, roll: RollingHash, length: int, gram: int):
    """Rows (document, first string, last string - first, anchor - first, anchor's hash, digest of all the bytes)."""
    n = len(data)
    width = length - gram + 1
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + tuple(np.zeros(0, dtype=np.uint64) for _ in range(2))
    prefix = roll.prefix(data)
    at = np.arange(n - gram + 1)
    key = roll.ranges(prefix, at, at + gram)
    low = (key & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    least, have = low, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        rest = width - have
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)  # of the string that starts at each place
    first = np.arange(len(anchor))
    doc = np.searchsorted(offsets, first, side="right") - 1
    whole = first + length <= offsets[doc + 1]
    first, anchor, doc = first[whole], anchor[whole], doc[whole]
    if not len(first):
        return anchors(data[:0], offsets[:1], roll, length, gram)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(first)) - 1
    lo, hi, own = first[begin], first[end], anchor[begin]
    return doc[begin], lo, hi - lo, own - lo, key[own], roll.ranges(prefix, lo, hi + length)


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of every text; ``hash`` is null for strings that repeat earlier ones of the same batch."""

    def run(batches):
        roll = RollingHash()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.int64)
            for row, hi in slices(offsets):
                end = offsets[hi]
                for start in range(int(offsets[row]), int(end), CHUNK):
                    stop = min(int(end), start + CHUNK + length - 1)
                    inside = np.clip(offsets[row : hi + 1] - start, 0, stop - start)
                    doc, lo, span, off, key, body = anchors(data[start:stop], inside, roll, length, gram)
                    if not len(doc):
                        continue
                    lo = lo + start - offsets[row + doc]
                    who, tag, shape = ids[row + doc], tags[row + doc], (span << 8 | off).astype(np.int32)
                    order = np.lexsort((lo, tag, who, body, key, shape))
                    who, tag, shape, lo, key, body = (x[order] for x in (who, tag, shape, lo, key, body))
                    known = np.zeros(len(lo), dtype=bool)
                    known[1:] = (key[1:] == key[:-1]) & (body[1:] == body[:-1]) & (shape[1:] == shape[:-1])
                    head = np.maximum.accumulate(np.where(known, 0, np.arange(len(lo))))
                    same_place = known & (who == who[head]) & (tag == tag[head]) & (lo == lo[head])
                    keep = ~same_place
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(key)[keep], mask=known[keep]), pa.array(who[keep]), pa.array(tag[keep]), pa.array(lo[keep]), pa.array(shape[keep])],
                        ["hash", "id", "tag", "lo", "shape"],
                    )

    return docs.select("id", "text").mapInArrow(lean(run), ANCHORS)


def with_contexts(repeated: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Repeated anchors with the bytes of all their strings, cut from the texts."""
    wanted = repeated.groupBy("id", "tag").agg(F.collect_list(F.struct("hash", "lo", "shape", "n")).alias("wanted"))
    schema = "hash long, id long, tag long, lo long, shape int, n long, context binary"

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(3))
            lists = batch.column(2)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            inner = lists.flatten()
            key, lo, shape, n = (inner.field(k) for k in range(4))
            row = np.repeat(np.arange(len(lists)), np.diff(at))
            start = offsets[row] + lo.to_numpy()
            size = (shape.to_numpy() >> 8) + length
            for k in range(0, len(row), 20_000):
                part = slice(k, k + 20_000)
                ends = np.concatenate([[0], np.cumsum(size[part])])
                take = np.arange(ends[-1]) - np.repeat(ends[:-1], size[part]) + np.repeat(start[part], size[part])
                context = pa.Array.from_buffers(
                    pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[take]))]
                )
                who = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [key[part], batch.column(0).take(who), batch.column(1).take(who), lo[part], shape[part], n[part], context],
                    ["hash", "id", "tag", "lo", "shape", "n", "context"],
                )

    return wanted.join(docs, ["id", "tag"]).select("id", "tag", "wanted", "text").mapInArrow(lean(run), schema)


def radix_groups(group: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) of the rows whose digits equal another row's in the same group: most significant digit first."""
    rows = np.arange(len(group))
    for k in range(-1, digits.shape[1]):
        if k >= 0:
            order = np.lexsort((digits[rows, k], group))
            rows, group = rows[order], group[order]
            digit = digits[rows, k]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        else:
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = group[1:] != group[:-1]
        group = np.cumsum(new) if len(new) else group
        several = np.bincount(group)[group] > 1 if len(new) else new
        rows, group = rows[several], group[several]
        if not len(rows):
            break
    return rows, group


RANGES = "id long, tag long, from long, to long"


def _ranges(who, tag, start):
    """Strings as runs of consecutive starts."""
    order = np.lexsort((start, tag, who))
    who, tag, start = who[order], tag[order], start[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1 if len(start) else begin
    return who[begin], tag[begin], start[begin], start[end]


def repeated_in(table: pa.Table, length: int):
    """Ranges of repeated strings among all occurrences of some anchors."""
    key, who, tag, lo = (table.column(c).to_numpy() for c in ("hash", "id", "tag", "lo"))
    shape = table.column("shape").to_numpy().astype(np.int64)
    context = table.column("context").combine_chunks() if isinstance(table.column("context"), pa.ChunkedArray) else table.column("context")
    code = context.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((lo, tag, who, code, shape, key))
    key, who, tag, lo, shape, code = (x[order] for x in (key, who, tag, lo, shape, code))
    again = np.zeros(len(lo), dtype=bool)
    again[1:] = (key[1:] == key[:-1]) & (shape[1:] == shape[:-1]) & (code[1:] == code[:-1])
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(lo))))
    same_place = again & (who == who[head]) & (tag == tag[head]) & (lo == lo[head])
    gone = again & ~same_place
    span = shape >> 8
    yield who[gone], tag[gone], lo[gone], lo[gone] + span[gone]
    first = np.flatnonzero(~again)
    alone = np.ones(len(first) + 1, dtype=bool)
    alone[1:-1] = key[first][1:] != key[first][:-1]
    first = first[~(alone[1:] & alone[:-1])]  # anchors with other surroundings elsewhere
    if not len(first):
        return
    data, offsets = text_buffer(context)
    data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    begin = offsets[order[first]]
    strings = span[first] + 1
    groups = np.flatnonzero(np.concatenate([[True], key[first][1:] != key[first][:-1]]))
    group_ends = np.append(groups[1:], len(first))
    total = np.concatenate([[0], np.cumsum(strings)])
    n_digits = -(-length // 8)
    g = 0
    while g < len(groups):
        a = groups[g]
        stop = int(np.searchsorted(total[group_ends], total[a] + SORT_ROWS, side="right"))
        g_end = max(stop, g + 1)
        b = group_ends[g_end - 1]
        g = g_end
        count = strings[a:b]
        rep = np.repeat(np.arange(a, b), count)
        step = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
        offset = (shape[first[rep]] & 0xFF) - step  # place of the anchor in the string
        raw = data[(begin[rep] + step)[:, None] + np.arange(8 * n_digits)]
        raw[:, length:] = 0
        digits = raw.view(">u8").astype(np.uint64)
        _, by_anchor = np.unique(key[first[rep]], return_inverse=True)
        rows, group = radix_groups(by_anchor * 256 + offset, digits)
        if not len(rows):
            continue
        place = first[rep[rows]]
        w, t, s = who[place], tag[place], lo[place] + step[rows]
        order2 = np.lexsort((s, t, w, group))
        w, t, s, group = w[order2], t[order2], s[order2], group[order2]
        later = np.zeros(len(s), dtype=bool)
        later[1:] = group[1:] == group[:-1]
        head2 = np.maximum.accumulate(np.where(later, 0, np.arange(len(s))))
        later &= ~((w == w[head2]) & (t == t[head2]) & (s == s[head2]))
        yield _ranges(w[later], t[later], s[later])


def repeated_strings(contexts: DataFrame, length: int) -> DataFrame:
    """Ranges of strings (first and last start) that also start earlier, for anchors of few occurrences."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 10_000:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("hash").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last anchor may go on in the next batch
            yield from emit(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
        if rows:
            yield from emit(pa.Table.from_batches(held))

    def emit(table):
        if table.num_rows:
            for columns in repeated_in(table, length):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "tag", "from", "to"])

    return contexts.repartition("hash").sortWithinPartitions("hash").mapInArrow(lean(run), RANGES)


def repeated_often(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many occurrences: equal strings meet by digest, aggregated in each task first."""
    place = F.struct("id", "tag", "lo")
    rows = stored(contexts.select("hash", "shape", "id", "tag", "lo", "context", F.sha2("context", 256).alias("body")), "often", release=True)
    heads = stored(rows.groupBy("hash", "shape", "body").agg(F.min(place).alias("head")), "often-heads")
    known = rows.drop("context").join(heads, ["hash", "shape", "body"]).where(place > F.col("head"))
    span = F.shiftright("shape", 8)
    ranges = known.select("id", "tag", F.col("lo").alias("from"), (F.col("lo") + span).alias("to"))
    unlike = rows.join(heads, ["hash", "shape", "body"]).where(place == F.col("head")).dropDuplicates(["hash", "shape", "body"])
    strings = stored(
        unlike.select("hash", "shape", "id", "tag", "lo", "context", F.explode(F.sequence(F.lit(0), span)).alias("step")).select(
            "hash", (F.col("shape").bitwiseAND(255) - F.col("step")).alias("offset"), "id", "tag", (F.col("lo") + F.col("step")).alias("lo"),
            F.unhex(F.sha2(F.substring("context", F.col("step") + 1, F.lit(length)), 256)).alias("body"),
        ),
        "often-strings",
        release=True,
    )
    first = stored(strings.groupBy("hash", "offset", "body").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "often-first")
    again = strings.join(first, ["hash", "offset", "body"]).where(place > F.col("head"))
    return ranges.union(again.select("id", "tag", F.col("lo").alias("from"), F.col("lo").alias("to")))


def cut_ranges(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """(mask of removed bytes, number of maximal runs) for byte ranges that may overlap."""
    change = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1]) > 0
    return gone, int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"))
    tagged = texts.withColumn("tag", F.crc32(F.coalesce("text", F.lit(""))))
    path = scratch_path(docs.sparkSession, "anchors")
    anchor_rows(texts, length, gram).write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(ANCHORS).parquet(path)
    counts = stored(found.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchor-counts", release=True)
    repeated = stored(found.where("hash is not null").join(counts, "hash"), "repeated-anchors", release=True)
    to = (F.col("lo") + F.shiftright("shape", 8)).alias("to")
    at_once = stored(found.where("hash is null").select("id", "tag", F.col("lo").alias("from"), to), "ranges-at-once")
    remove_path(docs.sparkSession, path)  # all that is needed of the anchors is written
    contexts = with_contexts(repeated.where(F.col("n") <= MANY), tagged, length)
    ranges = stored(repeated_strings(contexts, length), "ranges", release=True)
    often = repeated.where(F.col("n") > MANY)
    if not often.isEmpty():
        ranges = ranges.union(repeated_often(with_contexts(often, tagged, length), length))
    by_doc = ranges.union(at_once).groupBy("id", "tag").agg(F.collect_list("from").alias("starts"), F.collect_list("to").alias("ends"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            starts, ends = batch.column(2), batch.column(3)
            at = starts.offsets.to_numpy() - starts.offsets[0].as_py()
            begin, last = starts.flatten().to_numpy(), ends.flatten().to_numpy()
            removed, spans, digests, kept = [], [], [], []
            for d in range(batch.num_rows):
                text = data[offsets[d] : offsets[d + 1]]
                n, runs, rest = 0, 0, text
                if at[d + 1] > at[d]:
                    gone, runs = cut_ranges(text, begin[at[d] : at[d + 1]], last[at[d] : at[d + 1]] + length)
                    rest = text[~gone]
                    n = len(text) - len(rest)
                removed.append(n)
                spans.append(runs)
                digests.append(hashlib.sha256(rest.tobytes()).hexdigest())
                kept.append(rest.tobytes() if with_text else None)
            ids = batch.column(0).to_numpy()
            columns = [pa.array(ids, mask=ids == LAST), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    none = F.array().cast("array<bigint>")
    joined = tagged.join(by_doc, ["id", "tag"], "left").select(
        "id", "text", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends")
    )
    return joined.mapInArrow(lean(run), schema)
