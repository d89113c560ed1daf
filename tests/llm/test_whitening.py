import math
import random

import numpy as np
import pytest

from flowdetect.llm import queries
from flowdetect.llm.whitening import square_sums, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string, whitened string, id string, vector string"


def table(spark, vectors, schema=SCHEMA):
    rows = [(k, v, None, "a", None, "b", "c") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, schema).repartition(3)


def plain(vectors):
    """numpy on the centred integers."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)) + 1_000_000
    n = len(x)
    c = x - x.mean(axis=0)
    v = (c.T @ c) / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    return c, e[order], u[:, order], deviation, np.trace(v)


def check(df, vectors, ids):
    c, e, u, deviation, trace = plain(vectors)
    k = min(32, c.shape[1])
    got = df.toPandas()
    assert len(got) == len(vectors) * k and set(got["n"]) == {len(vectors)}
    assert got["identity_error"].nunique() == 1 and 0 <= got["identity_error"].iloc[0] <= 1e-4
    by = got.sort_values(["vec_id", "component"])
    white = by["whitened"].to_numpy().reshape(len(vectors), k)
    assert by["vec_id"].to_numpy().reshape(len(vectors), k)[:, 0].tolist() == ids
    assert by["deviation"].to_numpy().reshape(len(vectors), k)[:, 0].tolist() == deviation
    assert np.allclose(by["explained"].to_numpy()[:k], e[:k] / trace, rtol=1e-9)
    expected = (c @ u[:, :k]) / np.sqrt(e[:k])
    sign = np.sign((white * expected).sum(axis=0))
    assert np.abs(white - sign * expected).max() < 1e-6
    assert np.abs(white.T @ white / len(vectors) - np.eye(k)).max() < 1e-6


def test_whole_given_table_equals_numpy(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    check(queries.queries()["op11_polarisation_whitening"](spark, sf), [v for _, v in rows], [i for i, _ in rows])


def test_odd_rows(spark):
    rng = random.Random(3)
    good = [[rng.gauss(m, s) for m, s in ((0, 1), (500, 2), (-3, 30))] for _ in range(90)]
    good += [good[0], good[0]]  # repeated rows
    bad = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1.0, 2.0]]
    check(whiten(table(spark, good + bad)), good, list(range(len(good))))
    assert whiten(table(spark, bad[:5])).count() == 0
    assert whiten(table(spark, good).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_no_variance(spark):
    rows = whiten(table(spark, [[0.5, -0.5]] * 3 + [[0.5, 9.0]] * 2)).orderBy("component").collect()
    assert {r["component"]: r["whitened"] is None for r in rows} == {1: False, 2: True}
    assert all(r["whitened"] is None and r["deviation"] == 0 for r in whiten(table(spark, [[0.5, -0.5]])).collect())


def test_huge_entries_stay_exact(spark):
    vectors = [[1e15, 1.0], [-1e15, 2.0], [3e9, -5.0], [0.0, 7.0]]
    got = {r["vec_id"]: r["deviation"] for r in whiten(table(spark, vectors)).where("component = 1").collect()}
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    s = [sum(col) for col in zip(*x)]
    full = [sum((4 * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    assert [got[k] for k in range(4)] == [d if d < 1 << 63 else None for d in full]
    assert None in got.values()


@pytest.mark.parametrize("top", [1 << 10, 1 << 30, 1 << 61])
def test_square_sums_are_exact(top):
    rng = np.random.default_rng(top % 97)
    values = rng.integers(-top, top, size=(2048, 3))
    assert square_sums(values).tolist() == [sum(int(a) ** 2 for a in col) for col in values.T]
