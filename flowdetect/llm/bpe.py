"""BPE encoding and decoding through a table of distinct words (operator 9).

Texts are split into units (a word with its leading white space) in blocks of
rows. A block sends each of its distinct units once, with its place in the
block's list, to the unit's bucket (by hash). A bucket holds the equal units of
all blocks, encodes each once, and sends the ids back to the blocks, where they
are put in order by position. Units travel in compressed lists, one per
block and bucket. Decoding joins every id with its piece (the id-to-piece table has one row per
vocabulary entry) and reads the joined bytes as UTF-8.

Defined cases: null counts as empty and has no ids; repeated rows get equal
results; a null doc_id is carried along; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import RollingHash, lean, slices, stored, text_buffer
from flowdetect.llm.units import UnitEncoder, UnitTable, cut, flat_take, leading_space_units
from flowdetect.session import scratch_path

#: Bytes of text in one block; a longer document is a block of its own.
BLOCK_BYTES = 18 << 20
#: Rows of lists: units of a block (kind 0, one row per bucket) and the block's documents (kind 1).
LISTS = "kind int, block long, bucket int, body binary"
COLUMNS = ["kind", "block", "bucket", "body"]


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays and a last one of bytes as one compressed body; integers byte plane by byte plane."""
    *numbers, raw = arrays
    parts = [np.array([len(numbers), *(len(a) for a in numbers)], dtype="<i8").tobytes()]
    parts += [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in numbers]
    return zstandard.ZstdCompressor(level=5).compress(b"".join([*parts, raw.tobytes()]))


def expand(body: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8)
    n = int(data[:8].view("<i8")[0])
    sizes = data[8 : 8 + 8 * n].view("<i8")
    at, out = 8 + 8 * n, []
    for size in sizes.tolist():
        planes = data[at : at + 8 * size].reshape(8, size)
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64))
        at += 8 * size
    return [*out, data[at:]]


def text_blocks(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows of LISTS for blocks of texts."""

    def run(batches):
        roll = RollingHash()
        block = TaskContext.get().partitionId() << 24
        held, size = [], 0
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, BLOCK_BYTES):
                own = int(offsets[hi] - offsets[lo])
                if held and size + own > BLOCK_BYTES:
                    yield from lists(block, held, roll)
                    block, held, size = block + 1, [], 0
                held.append(batch.slice(lo, hi - lo))
                size += own
        if held:
            yield from lists(block, held, roll)

    def lists(block, parts, roll):
        table = pa.Table.from_batches(parts)
        data, offsets = text_buffer(table.column(1))
        starts = leading_space_units(data, offsets)
        index, units = np.zeros(0, dtype=np.int64), pa.array([], pa.string())
        if len(starts):
            coded = pc.dictionary_encode(cut(data, starts, np.append(starts[1:], len(data))))
            index, units = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        # frequent units first: their places are small numbers
        order = np.argsort(-np.bincount(index, minlength=len(units)), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        units = units.take(pa.array(order))
        names = table.column(0).combine_chunks()
        null = names.is_null().to_numpy(zero_copy_only=False)
        documents = squeeze(
            names.fill_null(0).to_numpy(zero_copy_only=False), null.astype(np.int64),
            np.diff(np.searchsorted(starts, offsets)), place[index], np.zeros(0, dtype=np.uint8),
        )
        raw, ends = text_buffer(units)
        bucket = (roll.ranges(roll.prefix(raw), ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = by_bucket[bounds[b] : bounds[b + 1]]  # places, ascending
            letters, sizes = flat_take(raw, ends, own)
            rows.append((0, block, b, squeeze(np.diff(own, prepend=0), sizes, letters)))
        rows.append((1, block, -1, documents))
        for k in range(0, len(rows), 64):
            kind, blocks, numbers, bodies = zip(*rows[k : k + 64])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(blocks, pa.int64()), pa.array(numbers, pa.int32()), pa.array(bodies, pa.binary())], COLUMNS
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), LISTS)


def by_block(lists: DataFrame, buckets: int) -> DataFrame:
    """``lists`` written as a table bucketed by block, so the documents need no shuffle when their ids come back."""
    spark = lists.sparkSession
    name = f"bpe_lists_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, name)
    spark.sql(f"CREATE TABLE {name} ({LISTS}) USING parquet CLUSTERED BY (block) INTO {buckets} BUCKETS LOCATION '{path}'")
    lists.write.mode("append").insertInto(name)
    return spark.table(name)


def encode_units(lists: DataFrame, tokenizer_json: str, mark: str, buckets: int) -> DataFrame:
    """(block, body) for every unit list: places, number of ids and ids of its units.

    Equal units meet in their bucket, where each is encoded once (again only
    when a task has seen more units than it may remember).
    """
    shared = lists.sparkSession.sparkContext.broadcast(tokenizer_json)  # the vocabulary file, of fixed size

    def run(batches):
        table = UnitTable(UnitEncoder(shared.value, mark))
        for batch in batches:
            out = []
            for body in batch.column(1):
                steps, sizes, letters = expand(body.as_py())
                ends = np.cumsum(sizes)
                units = cut(letters, ends - sizes, ends).to_pylist()
                ids, counts = flat_take_after(table, units)
                out.append(squeeze(steps, counts, ids, np.zeros(0, dtype=np.uint8)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "body"])

    return lists.repartition(buckets, "bucket").select("block", "body").mapInArrow(lean(run), "block long, body binary")


def flat_take_after(table: UnitTable, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = table.codes(units)  # may extend the table
    return flat_take(table.ids, table.offsets, codes)


def piece_table(tokenizer_json: str) -> list[bytes]:
    """Bytes of each id: byte-level pieces spell bytes with printable characters."""
    model = json.loads(tokenizer_json)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in set(printable)]
    to_byte |= {chr(256 + k): b for k, b in enumerate(others)}
    pieces = {i: p for p, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
    table = [b""] * (max(pieces) + 1)
    for i, piece in pieces.items():
        known = all(c in to_byte for c in piece)
        table[i] = bytes(to_byte[c] for c in piece) if known else piece.encode()
    return table


class Decoder:
    """Joins ids with their pieces, whole arrays at a time."""

    def __init__(self, table: list[bytes]):
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in table])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; malformed bytes become U+FFFD."""
        raw = flat_take(self.bytes, self.offsets, ids)[0].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


def assemble(encoded: DataFrame, bodies: DataFrame, tokenizer_json: str, with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, the digests of its ids and of their decoded text (and the ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(piece_table(tokenizer_json))  # one piece per vocabulary entry
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(units: pa.Table, documents: pa.Table) -> pa.Table:
        doc_id, null, per_doc, index, _ = expand(documents.column("body")[0].as_py())
        null, n = null.astype(bool), len(doc_id)
        lists = [expand(body.as_py()) for body in units.column("body")]
        join = lambda arrays: np.concatenate([np.zeros(0, dtype=np.int64), *arrays])
        place = join(np.cumsum(steps) for steps, _, _, _ in lists)
        count, ids_of = join(c for _, c, _, _ in lists), join(i for _, _, i, _ in lists)
        order = np.argsort(place)
        ids_of, count = flat_take(ids_of, np.concatenate([[0], np.cumsum(count)]).astype(np.int64), order)
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        decoder = Decoder(shared.value)
        texts = [",".join(map(str, ids_of[a:b].tolist())).encode() for a, b in zip(offsets[:-1], offsets[1:])]
        at = np.concatenate([[0], np.cumsum(per_doc)])
        out = [[], [], [], []]
        for d in range(n):
            places = index[at[d] : at[d + 1]]
            ids, _ = flat_take(ids_of, offsets, places)
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(b",".join([texts[p] for p in places.tolist()])).hexdigest())
            out[2].append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            if with_ids:
                out[3].append(ids.astype(np.int32))
        columns = [pa.array(doc_id, mask=null), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        if with_ids:
            columns.append(pa.array(out[3], type=pa.list_(pa.int32())))
        return pa.Table.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return encoded.groupBy("block").cogroup(bodies.groupBy("block")).applyInArrow(run, schema)


def encode_decode(docs: DataFrame, tokenizer_json: str, mark: str = "<|endoftext|>", id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text with a byte-level BPE file and decode its ids again.

    ``mark``: a special token of the file; texts may contain it.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = by_block(text_blocks(docs, id_col, text_col, buckets), buckets)
    encoded = stored(encode_units(lists.where("kind = 0").select("block", "body", "bucket"), tokenizer_json, mark, buckets), "bpe-ids", release=True)
    return assemble(encoded, lists.where("kind = 1").select("block", "body"), tokenizer_json, with_ids)
