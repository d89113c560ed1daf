import random
import re

import numpy as np

from flowdetect.llm import minhash
from flowdetect.llm.common import RangeHash
from flowdetect.llm.components import components, union_find
from flowdetect.llm.minhash import FULL, keep_one_of_each, near_duplicates, shingle_sets, superminhash
from tests.llm.cases import CLASH, by_id, documents, odd_rows, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOW))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def plain(rows, size):
    """component by id, and set sizes: all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    top = {i: i for i, _ in rows if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: find(i) for i in top}, [(i, len(s)) for i, s in sets]


def check(spark, rows, size=4, extra=()):
    top, sizes = plain(rows, size)
    out = near_duplicates(documents(spark, rows, extra), size).collect()
    assert sorted((str(i), n) for i, n in sizes) == sorted((str(r["doc_id"]), r["n_shingles"]) for r in out)
    for r in out:
        assert r["component_id"] == (None if r["doc_id"] is None else top[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def family(rng, n, words, edits, first_id):
    """One text and edited copies of it; ids in random order."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    ids = list(range(first_id, first_id + n))
    rng.shuffle(ids)
    return list(zip(ids, out))


def test_odd_rows(spark):
    check(spark, repeated(odd_rows()) + [(None, "no id"), (None, "no id"), (None, None)], extra=CLASH)
    assert near_duplicates(documents(spark, odd_rows()).limit(0)).count() == 0


def test_families_of_near_copies(spark):
    rng = random.Random(11)
    rows = family(rng, 60, 120, 9, 0) + family(rng, 40, 40, 3, 1_000) + family(rng, 40, 9, 2, 2_000) + family(rng, 30, 300, 30, 3_000)
    check(spark, rows)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(12)
    check(spark, family(rng, 50, 150, 14, 0) + family(rng, 30, 60, 5, 500))


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.int64).view(np.uint64)
    close, errors = [], []
    for trial in range(40):
        shared = base + np.uint64(trial)
        a = np.sort(np.concatenate([shared, rng.integers(0, 1 << 63, 50).view(np.uint64)]))
        b = np.sort(np.concatenate([shared, rng.integers(0, 1 << 63, 50).view(np.uint64)]))
        s = superminhash(np.repeat([0, 1], [450, 450]), np.concatenate([a, b]), 2)
        close.append((s[0] == s[1]).mean())
    assert abs(np.mean(close) - 400 / 500) < 0.02
    assert (superminhash(np.zeros(1, dtype=np.int64), np.array([7], dtype=np.uint64), 2)[0] != FULL).all()


def test_superminhash_equals_the_plain_algorithm():
    """Element by element, with a whole permutation each."""
    from flowdetect.llm.common import GOLD, mix

    keys = np.sort(mix(np.arange(30, dtype=np.uint64)))
    places = 96
    best = [FULL] * places
    for key in keys:
        order = list(range(places))
        for j in range(places):
            draw = int(mix(np.array([key]) + np.array([j + 1], dtype=np.uint64) * GOLD)[0])
            k = j + (((draw & 0xFFFFFFFF) * (places - j)) >> 32)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], (j << 32) | (draw >> 32))
    assert superminhash(np.zeros(len(keys), dtype=np.int64), keys, 1, places)[0].tolist() == best


def test_shingle_sets_of_short_texts():
    texts = [b"", b"a", b"A", b"a b", b"a b c d", b"a b c d e a b c d"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    docs, keys = shingle_sets(data, offsets, RangeHash(), 4)
    assert np.bincount(docs, minlength=6).tolist() == [0, 1, 1, 1, 1, 5]
    assert keys[docs == 1][0] == keys[docs == 2][0]


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(4)
    path = [(k, k + 1) for k in range(300)]
    star = [(5_000, 5_000 + k) for k in range(1, 200)]
    tree = [(9_000 + k, 9_000 + k // 2) for k in range(2, 100)]
    links = path + star + tree + [(7, 7)]
    rng.shuffle(links)
    out = components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()
    got = {r["node"]: r["component"] for r in out}
    assert len(out) == len(got)
    assert all(got[k] == 0 for k in range(301)) and all(got[5_000 + k] == 5_000 for k in range(200)) and all(got[9_000 + k] == 9_001 for k in range(1, 100))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    node, root = union_find(np.array([3, 1]), np.array([2, 3]))
    assert dict(zip(node.tolist(), root.tolist())) == {2: 1, 3: 1}


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(2)
    rows = family(rng, 20, 200, 4, 10) + [(500, "alone"), (501, None), (502, None), (None, "x y")]
    docs = documents(spark, rows, CLASH)
    kept = keep_one_of_each(docs, 5)
    top, _ = plain(rows, 5)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(i) for i in top if top[i] == i] + ["None"])


def swapped_texts():
    """Two different strings that a polynomial modulo 2^64 cannot tell apart."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_swapped_strings_are_two_words(spark):
    one, other = swapped_texts()
    got = by_id(near_duplicates(documents(spark, [(1, one), (2, other), (3, one)])))
    assert {k: r["component_id"] for k, r in got.items()} == {1: 1, 2: 2, 3: 1}
