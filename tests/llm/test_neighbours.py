import math
import random

import numpy as np
import pytest

from flowdetect.llm import neighbours as nn
from flowdetect.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, cell string, query string, mark string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, *"abcdef") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, every, top=10):
    """{query: [(distance, id)]}: brute force in double precision; an id is one item."""
    width = max(len(v) for _, v in rows)
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and len(v) == width]
    out = {}
    for q, a in good:
        if q % every == 0:
            best = out.setdefault(q, {})
            for i, b in good:
                if i != q:
                    best[i] = min(best.get(i, math.inf), math.sqrt(((a - b) ** 2).sum()))
    return {q: sorted((d, i) for i, d in best.items())[:top] for q, best in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, true):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in best}) for q, best in true.items())
    return hits / sum(len(best) for best in true.values())


def ordered(got):
    return all(best == sorted(best) for best in got.values())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    true = plain(rows, 100)
    got = found(queries.queries()["op12_cross_polytope_neighbours"](spark, path))
    assert set(got) == set(true) and all(len(v) == 10 for v in got.values()) and ordered(got)
    assert recall(got, true) >= 0.9
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    assert all(abs(s - np.linalg.norm(vectors[q] - vectors[i])) < 1e-12 for q, best in got.items() for s, i in best)


def test_odd_rows_equal_brute_force(spark):
    rng = random.Random(4)
    good = [(k, [rng.gauss(0, 1) * 10 ** (k % 3) for _ in range(5)]) for k in range(300)]
    good += [(k, good[10][1]) for k in range(1_000, 1_060)]  # a group of equal vectors larger than the result
    good += [good[3], good[3], (3, good[8][1]), (20, [0.5] * 5)]  # repeated rows, ids of several vectors
    bad = [(5_000, None), (5_010, []), (5_020, [0.0] * 5), (5_030, [1.0, None, 1.0, 1.0, 1.0]), (5_040, [math.nan] * 5), (5_050, [math.inf] * 5), (5_060, [1.0] * 4), (None, [1.0] * 5)]
    df = table(spark, good + bad)
    got = found(nn.nearest_neighbours(df, "id % 10 = 0", covered=1.0, sample=10_000))
    true = plain(good, 10)
    assert set(got) == set(true)
    assert recall(got, true) > 0.99
    for q, best in got.items():
        if best != true[q]:  # only what no probe reached may differ
            assert set(best) <= set(plain(good, 10, 10_000)[q])
    assert got[1_000] == true[1_000] and got[1_050] == true[1_050]
    # few candidates, no queries, empty tables
    few = found(nn.nearest_neighbours(table(spark, good[:4]), "id % 10 = 0"))
    assert few == plain(good[:4], 10) and len(few[0]) == 3
    assert nn.nearest_neighbours(df, "id < 0").count() == 0
    assert nn.nearest_neighbours(df.limit(0), "id % 10 = 0").count() == 0
    assert nn.nearest_neighbours(table(spark, good[:1]), "id % 10 = 0").count() == 0
    assert nn.nearest_neighbours(table(spark, bad[:6]), "id % 10 = 0").count() == 0


def test_more_digits_and_blocks(spark, monkeypatch):
    """Small cells and blocks: several digits, a hot cell in many blocks."""
    monkeypatch.setattr(nn, "CELL_ROWS", 4)
    monkeypatch.setattr(nn, "BLOCK_VECTORS", 16)
    rng = np.random.default_rng(6)
    hot = rng.normal(size=12)
    rows = [(k, (hot + 0.001 * rng.normal(size=12) if k % 3 == 0 else rng.normal(size=12)).tolist()) for k in range(900)]
    assert len(nn.Tables(12, 900).axes) == 2
    got = found(nn.nearest_neighbours(table(spark, rows), "id % 20 = 0"))
    assert recall(got, plain(rows, 20)) >= 0.9 and ordered(got)


def test_probes_are_ordered_and_complete():
    rng = np.random.default_rng(1)
    tables = nn.Tables(10, 900_000)
    vectors = rng.normal(size=(5, 10))
    assert tables.axes[0] == 32 and len(tables.axes) == 2
    order = tables.probes(vectors, 1, tables.cells())
    assert (np.sort(order, axis=1) == np.arange(tables.cells())).all()
    assert (order[:, 0] == tables.cell(vectors, 1)).all()
    assert (tables.probes(vectors, 1, 7) == order[:, :7]).all()


def test_rotation_keeps_lengths():
    rows = np.random.default_rng(0).normal(size=(3, 16))
    assert np.allclose(nn.hadamard(rows) @ nn.hadamard(rows).T, rows @ rows.T)
    assert np.allclose(nn.hadamard(nn.hadamard(rows)), rows)
