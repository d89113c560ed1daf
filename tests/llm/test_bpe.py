import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowdetect.llm import bpe
from flowdetect.llm.queries import BPE_VOCABULARY, vocabulary
from tests.llm.cases import CLASH, documents, odd_rows, repeated

SPACES = [
    "a   b", "a　 b", "x \ny", "a\u0085 b", " lead", "trail  ", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "don't  we'll 's",
    "\t\ttabs\t \tmixed\n\n\nlines\r\nend", "1 23² ½4", "\x1c\x1d sep", "zero​width  ogham", "<|endoftext", "á ́b",
]


def test_equals_the_library(spark):
    rows = repeated(odd_rows()) + [(50 + k, t) for k, t in enumerate(SPACES)] + [(None, "no id")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BPE_VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    docs = documents(spark, rows, CLASH)
    out = bpe.encode_decode(docs, vocabulary(BPE_VOCABULARY), with_ids=True).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"])) for r in out) == sorted(expected)
    assert bpe.encode_decode(docs.limit(0), vocabulary(BPE_VOCABULARY)).count() == 0
    nothing = bpe.encode_decode(documents(spark, [(1, None), (2, "")]), vocabulary(BPE_VOCABULARY)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in nothing} == {(k, 0, hashlib.sha256(b"").hexdigest()) for k in (1, 2)}


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = documents(spark, odd_rows())
    whole = sorted(map(tuple, bpe.encode_decode(docs, vocabulary(BPE_VOCABULARY)).collect()))
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 3_000)
    assert sorted(map(tuple, bpe.encode_decode(docs, vocabulary(BPE_VOCABULARY)).collect())) == whole


def test_equal_units_of_all_blocks_meet_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 3_000)
    rows = bpe.text_blocks(documents(spark, odd_rows()), "doc_id", "text", 5).where("kind = 0").collect()
    assert len({r["block"] for r in rows}) > 5
    home, per_block = {}, {}
    for r in rows:
        steps, sizes, letters = bpe.expand(bytes(r["body"]))
        ends = sizes.cumsum()
        for unit in (letters[e - n : e].tobytes() for e, n in zip(ends, sizes)):
            assert home.setdefault(unit, r["bucket"]) == r["bucket"]
            assert unit not in per_block.setdefault(r["block"], set())
            per_block[r["block"]].add(unit)


def test_bodies_expand_to_what_was_squeezed():
    arrays = [np.array([], dtype=np.int64), np.array([0, 1 << 40, 77]), np.frombuffer(b"abc", dtype=np.uint8)]
    out = bpe.expand(bpe.squeeze(*arrays))
    assert [a.tolist() for a in out] == [a.tolist() for a in arrays]
