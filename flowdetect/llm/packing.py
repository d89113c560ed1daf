"""Packing of tokenized documents into fixed-length sequences (operator 3).

Shortest-pack-first over the length histogram: lengths are placed longest
first, each into the packs with the most room left; packs with equal contents
are one pattern with a count, so the work depends on the number of lengths
(2048 at most), not of documents. Pieces are then numbered inside their length
and the patterns are joined back by that rank.

A document is its token ids followed by the end id. A document longer than a
sequence is cut into full sequences and a rest.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed one by one; a null id is carried along; an empty table gives no pieces;
extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.blocks import numbered
from flowdetect.llm.common import lean, stored, text_slices
from flowdetect.llm.units import SPACE_MARK, UNIT_SLICE, LowerUnitEncoder, UnitTable, flat_take, lower_units

SEQUENCE = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_json: str, sequence: int = SEQUENCE, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``sequence`` ids of every document; ``with_ids`` adds the ids themselves.

    ``tokenizer_json``: content of a tokenizers file that lowers the case, drops
    white space, splits letters, digits and signs, and is byte-level.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # the vocabulary file, of fixed size
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        table = UnitTable(LowerUnitEncoder(shared.value, SPACE_MARK))
        for batch in batches:
            names = batch.column(0)
            for first, data, offsets in text_slices(batch.column(1), UNIT_SLICE):
                codes, per_doc = lower_units(data, offsets, table)
                ids, counts = flat_take(table.ids, table.offsets, codes)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                ends = bounds[np.concatenate([[0], np.cumsum(per_doc)])]
                rows, arrays = [], []
                for d in range(len(offsets) - 1):
                    own = np.append(ids[ends[d] : ends[d + 1]], end_id).astype("<u4")
                    for start in range(0, len(own), sequence):
                        part = own[start : start + sequence]
                        rows.append((first + d, start, len(part), zlib.crc32(part.tobytes()), len(own)))
                        if with_ids:
                            arrays.append(part.astype(np.int32))
                table_rows = np.array(rows, dtype=np.int64).reshape(-1, 5)
                out = [names.take(pa.array(table_rows[:, 0])), *(pa.array(table_rows[:, k]) for k in range(1, 5))]
                if with_ids:
                    out.append(pa.array(arrays, type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def shortest_pack_first(histogram: dict[int, int], sequence: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that use every length of the histogram exactly as often as it occurs."""
    packs: list[list[tuple[int, tuple]]] = [[] for _ in range(sequence + 1)]  # by room left: (count, linked lengths)
    most = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most > 0 and not packs[most]:
                most -= 1
            if most >= length:
                count, held = packs[most].pop()
                used = min(count, left)
                if used < count:
                    packs[most].append((count - used, held))
                room = most - length
            else:
                used, held, room = left, (), sequence - length
            packs[room].append((used, (length, held)))
            most = max(most, room)
            left -= used
    out = []
    for group in packs:
        for count, held in group:
            lengths = []
            while held:
                lengths.append(held[0])
                held = held[1]
            out.append((count, lengths[::-1]))
    return out


#: Ranks stay below 2**44 and lengths below 2**19, so one integer holds both.
RANK_BITS = 44


def rank_table(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (first length and rank, first rank, first sequence, offset): one per pattern and place in it, sorted."""
    taken: dict[int, int] = {}
    rows = []
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append(((length << RANK_BITS) + rank, rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def find_place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset that the patterns give to the piece of that length and rank."""
    row = table[np.searchsorted(table[:, 0], (length << RANK_BITS) + rank, side="right") - 1]
    return row[:, 2] + rank - row[:, 1], row[:, 3]


def pack(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``parts`` (with a ``length`` column) with sequence_id and offset.

    The histogram has ``sequence`` rows at most, so it is gathered on the
    driver whatever the number of pieces; the patterns' table is bounded by
    the same number of lengths (some tens of thousands of rows) and broadcast.
    """
    spark, columns = parts.sparkSession, parts.columns
    ranked = stored(numbered(parts, "length", "_rank", "pieces"), "ranked")
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lookup = spark.sparkContext.broadcast(rank_table(shortest_pack_first(histogram, sequence)))

    def place(batches):
        for batch in batches:
            where = {name: i for i, name in enumerate(batch.schema.names)}
            values = [batch.column(where[c]).to_numpy() for c in ("length", "_rank")]
            ids, offsets = find_place(lookup.value, *values)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(where[c]) for c in columns), pa.array(ids), pa.array(offsets)], [*columns, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
