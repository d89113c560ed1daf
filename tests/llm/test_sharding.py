import zlib

import numpy as np

from flowdetect.llm.common import mix
from flowdetect.llm.sharding import assign_shards, jump_hash, write_shards
from tests.llm.cases import CLASH, documents, odd_rows, repeated


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_loop():
    keys = mix(np.arange(500, dtype=np.uint64))
    for n in (1, 2, 24, 25, 1000):
        assert jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_growing_moves_rows_only_into_the_new_shard():
    keys = mix(np.arange(20_000, dtype=np.uint64))
    old, new = jump_hash(keys, 24), jump_hash(keys, 25)
    assert ((new == old) | (new == 24)).all()
    assert abs((new == 24).mean() - 1 / 25) < 0.006


def test_shards_sizes_and_slots(spark):
    rows = repeated(odd_rows()) + [(None, "no id"), (None, None)]
    out = assign_shards(documents(spark, rows, CLASH)).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted(
        (i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r["slot"])
        if r["doc_id"] is not None:
            assert r["shard"] == plain_jump(int(mix(np.array([r["doc_id"]], dtype=np.int64).view(np.uint64))[0]), 24)
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1


def test_empty_and_written_shards(spark, scratch):
    docs = documents(spark, odd_rows())
    assert assign_shards(docs.limit(0)).count() == 0
    path = scratch("shards")
    write_shards(docs, path)
    assert spark.read.parquet(path).count() == docs.count()


def test_slots_over_many_small_blocks(spark, monkeypatch):
    from flowdetect.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    monkeypatch.setattr(blocks, "BLOCKS_PER_RUN", 3)
    df = spark.range(0, 500, 1, 4).selectExpr("id", "id % 3 as g")
    out = blocks.numbered(df, "g", "n", "blocks").collect()
    assert len(out) == 500
    for g in range(3):
        numbers = [r["n"] for r in out if r["g"] == g]
        assert sorted(numbers) == list(range(len(numbers)))
