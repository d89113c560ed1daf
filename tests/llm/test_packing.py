import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowdetect.llm.packing import END_ID, SEQUENCE, find_place, pack, pieces, rank_table, shortest_pack_first
from flowdetect.llm.queries import PACKING_VOCABULARY, vocabulary
from tests.llm.cases import CLASH, documents, odd_rows, repeated


def test_patterns_use_every_length_once():
    rng = random.Random(3)
    histogram = {length: rng.randrange(1, 400) for length in rng.sample(range(1, 129), 60)} | {1: 5_000, 128: 7}
    patterns = shortest_pack_first(histogram, 128)
    used = {}
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 128 and lengths == sorted(lengths, reverse=True)
        for length in lengths:
            used[length] = used.get(length, 0) + count
    assert used == histogram
    table = rank_table(patterns)
    sequences = sum(count for count, _ in patterns)
    taken = {}
    for length, n in histogram.items():
        ids, offsets = find_place(table, np.full(n, length), np.arange(n))
        for s, o in zip(ids.tolist(), offsets.tolist()):
            taken.setdefault(s, []).append((o, length))
    assert sorted(taken) == list(range(sequences))
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert shortest_pack_first({}, 128) == [] and len(rank_table([])) == 0


def test_ids_are_packed_once_in_order(spark):
    rows = repeated(odd_rows()) + [(None, "no id")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(PACKING_VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = {}
    for i, t in rows:
        expected.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID])
    parts = pieces(documents(spark, rows, CLASH), vocabulary(PACKING_VOCABULARY), with_ids=True)
    out = pack(parts).collect()
    got, sequences = {}, {}
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(got) == set(expected)
    for i, texts in expected.items():
        assert sorted(got[i]) == sorted((s, t[s : s + SEQUENCE], len(t)) for t in texts for s in range(0, len(t), SEQUENCE))
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    assert pack(pieces(documents(spark, rows).limit(0), vocabulary(PACKING_VOCABULARY))).count() == 0
