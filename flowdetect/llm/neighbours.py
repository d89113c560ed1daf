"""Approximate nearest neighbours by cross-polytope hashing (operator 12).

A table of the index turns every unit vector by fast Hadamard pseudo-rotations
(random signs, Hadamard transform, three times) and puts it into the cell of the
nearest signed axis. Beyond ``CELL_ROWS`` rows a cell, further digits (of another
rotation, over as many axes as needed) split the cells. A query probes its
nearest cells in every table, in the order of their distance, and all vectors of
a probed cell are reranked by their exact distance to it.

How many cells a query probes is measured: the exact neighbours of a fixed
sample of queries are found among all vectors, and the probes reach the cells
of at least ``COVERED`` of them. Every vector is indexed; no cell is capped.
A large cell is cut into blocks by a hash of the vector's id, and each query of
the cell meets each block once, in a task of its own.

Equal vectors: only the smallest ids of a group, one more than are asked for,
can be among anybody's nearest, so the rest leaves the index (they remain
queries); equal query vectors are searched once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
entries take no part, nor do vectors of another length than the commonest (of
equally common lengths, the longest), nor rows with a null id. Rows repeated
under one id are one item, whose distance is the smallest of its vectors'.
Ties go to the smaller id. Extra columns are not read; without queries or
candidates the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.llm.common import lean, stored, stream
from flowdetect.llm.vectors import blocks, finite_rows

TOP = 10
TABLES = 2
TURNS = 3
#: Vectors that a cell holds on average at most, and vectors of one block of a cell.
CELL_ROWS, BLOCK_VECTORS = 4096, 4096
#: Sampled queries, and the share of their true neighbours whose cells the probes must reach.
SAMPLE, COVERED = 256, 0.97
#: Queries compared with a block at once.
QUERY_ROWS = 256
#: Cells whose costs are held at once while probes are chosen, and cells searched for the neighbours of a sampled query.
PROBE_CELLS, SAMPLE_CELLS = 1 << 22, 1 << 14

RESULT = "query_id long, rank int, vec_id long, score double"


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row (length a power of two), as an orthogonal map."""
    n, width = rows.shape
    half = 1
    while half < width:
        pair = rows.reshape(n, -1, 2, half)
        rows = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


class Tables:
    """The rotations of the index: ``tables`` hashes of one or more digits.

    ``axes``: signed axes of each digit; their product is the number of cells of a table.
    """

    def __init__(self, width: int, rows: int, tables: int = TABLES):
        self.width, self.count = width, tables
        self.padded = 1 << max(width - 1, 0).bit_length()
        self.axes = [2 * self.padded]
        while self.cells() * CELL_ROWS < rows:
            missing = -(-rows // (CELL_ROWS * self.cells()))
            self.axes.append(min(2 * self.padded, 1 << (missing - 1).bit_length()))
        signs = stream(71, tables * len(self.axes) * TURNS * self.padded) & np.uint64(1)
        self.signs = np.where(signs == 0, -1.0, 1.0).reshape(tables, len(self.axes), TURNS, self.padded)

    def cells(self) -> int:
        return int(np.prod(self.axes, dtype=np.int64))

    def turned(self, vectors: np.ndarray, table: int, digit: int) -> np.ndarray:
        """Closeness of every vector to every signed axis of a digit."""
        unit = np.zeros((len(vectors), self.padded))
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        unit[:, : self.width] = vectors / largest  # entries of any size
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for turn in range(TURNS):
            unit = hadamard(unit * self.signs[table, digit, turn])
        axes = unit[:, : self.axes[digit] // 2]
        return np.concatenate([axes, -axes], axis=1)

    def cell(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Cell of every vector."""
        out = np.zeros(len(vectors), dtype=np.int64)
        for digit, axes in enumerate(self.axes):
            out = out * axes + self.turned(vectors, table, digit).argmax(axis=1)
        return out

    def probes(self, vectors: np.ndarray, table: int, number: int) -> np.ndarray:
        """The ``number`` cells nearest to every vector, nearest first (all cells, if fewer).

        A cell costs the sum, over its digits, of the squared gap between the
        axis and the nearest one. The best cells continue the best beginnings.
        """
        step = max(1, PROBE_CELLS // (min(number, self.cells()) * max(self.axes)))
        parts = [self._probes(vectors[lo : lo + step], table, number) for lo in range(0, len(vectors), step)]
        return np.concatenate(parts) if parts else np.zeros((0, 1), dtype=np.int64)

    def _probes(self, vectors: np.ndarray, table: int, number: int) -> np.ndarray:
        code = np.zeros((len(vectors), 1), dtype=np.int64)
        cost = np.zeros((len(vectors), 1))
        for digit, axes in enumerate(self.axes):
            near = self.turned(vectors, table, digit)
            gap = (near.max(axis=1, keepdims=True) - near) ** 2
            code = (code[:, :, None] * axes + np.arange(axes)[None, None, :]).reshape(len(vectors), -1)
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(vectors), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :number]
            code, cost = np.take_along_axis(code, best, axis=1), np.take_along_axis(cost, best, axis=1)
        return code


def nearest(queries, ids, vectors, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, distances) of the ``top`` nearest vectors of every query, ties by id; the distances are exact doubles.

    Products choose, with room for their rounding; differences decide.
    """
    with np.errstate(all="ignore"):
        size, own = (vectors**2).sum(axis=1), (queries**2).sum(axis=1)
        rough = own[:, None] + size[None, :] - 2 * queries @ vectors.T
        rough = np.where(np.isfinite(rough), rough, -np.inf)  # too large for squares: decided exactly
        slack = 1e-9 * (own + (size.max() if len(size) else 0.0))
    out = []
    for row, query, room in zip(rough, queries, slack):
        if len(row) > top:
            limit = np.partition(row, top - 1)[top - 1] + room
            at = np.flatnonzero(~(row > limit))
        else:
            at = np.arange(len(row))
        gaps = vectors[at] - query
        with np.errstate(over="ignore"):
            exact = np.sqrt((gaps * gaps).sum(axis=1))
        order = np.lexsort((ids[at], exact))[:top]
        out.append((ids[at][order], exact[order]))
    return out


def _found(query: np.ndarray, mark: np.ndarray, results) -> pa.RecordBatch:
    sizes = [len(ids) for ids, _ in results]
    ids, scores = (np.concatenate([r[k] for r in results]) for k in (0, 1))
    columns = [np.repeat(query, sizes), np.repeat(mark, sizes), ids.astype(np.int64), scores]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "mark", "vec_id", "score"])


FOUND = "query long, mark long, vec_id long, score double"


def scan(vectors: DataFrame, queries: np.ndarray, top: int) -> DataFrame:
    """The nearest of every block of all vectors, for a bounded number of queries (told by their number)."""
    width, number = queries.shape[1], np.arange(len(queries))

    def run(batches):
        for batch in batches:
            for lo, block in blocks(batch.column(1), width, BLOCK_VECTORS):
                ids = batch.column(0).slice(lo, len(block)).to_numpy()
                yield _found(number, number, nearest(queries, ids, block, top))

    return vectors.mapInArrow(lean(run), FOUND)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` nearest of every query, an id once: one shuffle by the query."""
    key = ["query", "mark"]
    once = found.repartition(*key).groupBy(*key, "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("score", "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top)


def probes_needed(vectors: DataFrame, queries: DataFrame, tables: Tables, top: int, covered: float, sample: int) -> int:
    """Cells that a query must probe in each table to reach ``covered`` of the sampled queries' true neighbours."""
    rows = queries.orderBy(F.xxhash64("id", "mark"), "id", "mark").limit(sample).collect()  # at most ``sample`` vectors
    asked = np.array([r["vector"] for r in rows], dtype=np.float64)
    true = ranked(scan(vectors, asked, top + 1), top + 1).select("query", F.col("vec_id").alias("id"))
    near = true.join(vectors, "id").select("query", "id", "vector").collect()  # top + 1 a query
    near = [r for r in near if r["id"] != rows[r["query"]]["id"]]
    if not near:
        return 1
    of, found = np.array([r["query"] for r in near]), np.array([r["vector"] for r in near], dtype=np.float64)
    place = np.full(len(near), tables.cells())
    for table in range(tables.count):
        number = min(tables.cells(), SAMPLE_CELLS)
        order = tables.probes(asked, table, number)[of]
        hit = order == tables.cell(found, table)[:, None]
        place = np.where(hit.any(axis=1), np.minimum(place, hit.argmax(axis=1)), place)
    place.sort()
    return int(place[min(len(place) - 1, int(np.ceil(covered * len(place))) - 1)]) + 1


def _kind(vectors: DataFrame) -> str:
    return vectors.schema["vector"].dataType.simpleString()


def in_cells(vectors: DataFrame, tables: Tables, payload: bool) -> DataFrame:
    """(cell, id[, vector]) of every vector in every table; tables have cells of their own."""

    def run(batches):
        for batch in batches:
            for lo, block in blocks(batch.column(1), tables.width):
                rows = batch.slice(lo, len(block))
                for table in range(tables.count):
                    cell = pa.array(table * tables.cells() + tables.cell(block, table))
                    kept = [rows.column(0), rows.column(1)] if payload else []
                    yield pa.RecordBatch.from_arrays([cell, *kept], ["cell", "id", "vector"] if payload else ["cell"])

    return vectors.mapInArrow(lean(run), f"cell long, id long, vector {_kind(vectors)}" if payload else "cell long")


def probing(queries: DataFrame, tables: Tables, number: int) -> DataFrame:
    """(cell, id, mark, vector) of every query and every cell that it probes."""

    def run(batches):
        for batch in batches:
            for lo, block in blocks(batch.column(2), tables.width, 64):
                rows = batch.slice(lo, len(block))
                for table in range(tables.count):
                    cells = tables.probes(block, table, number)
                    at = pa.array(np.repeat(np.arange(len(block)), cells.shape[1]))
                    cell = pa.array(table * tables.cells() + cells.ravel())
                    yield pa.RecordBatch.from_arrays([cell, *[rows.column(k).take(at) for k in range(3)]], ["cell", "id", "mark", "vector"])

    return queries.select("id", "mark", "vector").mapInArrow(lean(run), f"cell long, id long, mark long, vector {_kind(queries)}")


def meet(members: DataFrame, asked: DataFrame, sizes: DataFrame, width: int, top: int) -> DataFrame:
    """Every query against every block of its cells.

    Members lie in block hash(id) of their cell; queries visit all blocks. Rows of
    a block stand together, members first, so a task holds one block and a few queries.
    """
    count = sizes.select("cell", F.ceil(F.col("n") / BLOCK_VECTORS).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    placed = members.join(count, "cell").select("cell", block, F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("mark"), "vector")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    visits = asked.join(count, "cell").select("cell", every, F.lit(1).alias("kind"), "id", "mark", "vector")

    def matrix(part):
        return next((m for _, m in blocks(part.column(5), width, part.num_rows)))

    def run(batches):
        here, ids, vectors, body = None, [], [], None
        for batch in batches:
            cell, block, kind = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if (cell[lo], block[lo]) != here:
                    here, ids, vectors, body = (cell[lo], block[lo]), [], [], None
                if kind[lo] == 0:
                    ids.append(part.column(3).to_numpy())
                    vectors.append(matrix(part))
                elif ids:
                    body = body or (np.concatenate(ids), np.concatenate(vectors))
                    for at in range(0, part.num_rows, QUERY_ROWS):
                        some = part.slice(at, QUERY_ROWS)
                        yield _found(some.column(3).to_numpy(), some.column(4).to_numpy(), nearest(matrix(some), *body, top))

    both = placed.unionByName(visits).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return both.mapInArrow(lean(run), FOUND)


def nearest_neighbours(
    df: DataFrame, is_query, *, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, covered: float = COVERED, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest vectors found for every row that ``is_query`` (a condition on ``id``) picks."""
    spark = df.sparkSession
    rows, width = finite_rows(df, id_col, vector_col, nonzero=True)
    rows = rows.where("id is not null")
    if not width:
        return spark.createDataFrame([], RESULT)
    # of equal vectors, the smallest ids; the rank's filter works in every task before the shuffle
    order = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    vectors = stored(rows.withColumn("at", order).where(F.col("at") <= top + 1).select("id", "vector").dropDuplicates(["vector", "id"]), "vectors")
    own = stored(rows.where(is_query).distinct(), "query-rows")
    queries = own.groupBy("vector").agg(F.min("id").alias("id"))
    queries = stored(queries.select("id", F.xxhash64("vector").alias("mark"), "vector"), "queries")  # an id may hold several vectors
    if not queries.limit(1).count():
        return spark.createDataFrame([], RESULT)
    index = Tables(width, vectors.count(), tables)
    number = probes_needed(vectors, queries, index, top, covered, sample)
    sizes = stored(in_cells(vectors, index, False).groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    found = meet(in_cells(vectors, index, True), probing(queries, index, number), sizes, width, top + 1)
    best = stored(ranked(found, top + 1).select("query", "mark", "vec_id", "score"), "found")
    asked = own.select(F.col("id").alias("query_id"), "vector").join(queries, "vector").select("query_id", F.col("id").alias("query"), "mark")
    rows = asked.join(best, ["query", "mark"]).where("query_id <> vec_id")
    rows = rows.select(F.col("query_id").alias("query"), F.lit(0).cast("long").alias("mark"), "vec_id", "score")
    return ranked(rows, top).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
