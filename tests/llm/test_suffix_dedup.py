import hashlib
import random

import numpy as np

from flowdetect.llm import suffix_dedup
from flowdetect.llm.common import RollingHash
from flowdetect.llm.suffix_dedup import anchors, radix_groups, remove_repeats
from tests.llm.cases import CLASH, by_id, documents, odd_rows, repeated


def plain(rows, length):
    """Removed bytes, runs and digest by id; ids unique."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = [True] * length
            seen.add(raw[s : s + length])
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest(), rest)
    return out


def check(spark, rows, length=100, gram=32, extra=()):
    expected = plain(rows, length)
    got = by_id(remove_repeats(documents(spark, rows, extra), length, gram, with_text=True))
    assert set(got) == set(expected)
    for i, r in got.items():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == expected[i], i


def copies(rng, n):
    base = ["".join(rng.choice("abc ") for _ in range(400)) for _ in range(4)]
    rows = []
    for k in range(n):
        text = "".join(rng.choice("xyz ") for _ in range(rng.randrange(60)))
        for _ in range(rng.randrange(4)):
            b = rng.choice(base)
            s = rng.randrange(300)
            text += b[s : s + rng.randrange(250)] + "".join(rng.choice("uvw") for _ in range(rng.randrange(30)))
        rows.append((k * 3, text))
    return rows


def test_odd_rows(spark):
    check(spark, odd_rows() + [(None, odd_rows()[3][1] + " x")], extra=CLASH)
    assert remove_repeats(documents(spark, odd_rows()).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = odd_rows()
    out = remove_repeats(documents(spark, repeated(rows))).collect()
    expected = plain(rows, 100)
    assert len(out) == len(rows) + 3
    assert all((r["n_removed"], r["kept_sha256"]) == (expected[r["doc_id"]][1], expected[r["doc_id"]][3]) for r in out)


def test_mixed_passages(spark):
    check(spark, copies(random.Random(1), 120))


def test_other_lengths(spark):
    check(spark, copies(random.Random(2), 60), length=37, gram=9)


def test_frequent_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    check(spark, copies(random.Random(3), 100) + [(9_000 + k, "head %d " % k + "common line " * 12 + str(k)) for k in range(30)])


def test_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 150)
    check(spark, copies(random.Random(4), 50) + odd_rows()[:30])


def test_every_string_has_one_anchor_and_equal_strings_equal_ones():
    rng = np.random.default_rng(3)
    part = rng.integers(97, 101, 300).astype(np.uint8)
    data = np.concatenate([part, rng.integers(97, 101, 77).astype(np.uint8), part])
    offsets = np.array([0, 300, 300, 377, 677])
    doc, lo, span, off, key, body = anchors(data, offsets, RollingHash(), 100, 32)
    starts = sorted((int(offsets[d]) + s if False else int(a) + s) for d, a, n in zip(doc, lo, span) for s in range(n + 1))
    assert starts == [*range(0, 201), *range(377, 578)]
    first = [(int(a), int(n), int(o), int(k)) for d, a, n, o, k in zip(doc, lo, span, off, key) if d == 0]
    assert first == [(int(a) - 377, int(n), int(o), int(k)) for d, a, n, o, k in zip(doc, lo, span, off, key) if d == 3]
    assert (off - span >= 0).all() and (off <= 68).all()


def test_radix_groups_equal_the_plain_grouping():
    rng = np.random.default_rng(5)
    digits = rng.integers(0, 2, (200, 4)).astype(np.uint64)
    group = rng.integers(0, 5, 200)
    rows, found = radix_groups(group, digits)
    plain_groups = {}
    for k in range(200):
        plain_groups.setdefault((int(group[k]), *digits[k].tolist()), []).append(k)
    got = {}
    for r, g in zip(rows.tolist(), found.tolist()):
        got.setdefault(g, []).append(r)
    assert sorted(sorted(v) for v in got.values()) == sorted(v for v in plain_groups.values() if len(v) > 1)
