import math
import random
import re
from collections import Counter

import numpy as np

from flowdetect.llm import ranked_search as rs
from tests.llm.cases import CLASH, documents, odd_rows, repeated

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, top=20):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    least = {}
    for i, t in items:
        if i is not None and t is not None:
            least[i] = min(least.get(i, t), t, key=lambda x: x.encode())
    out = []
    for item, text in least.items():
        scored = []
        for i, c in docs:
            if i is None or not c:
                continue
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, score string, doc_id string")


def search(docs, items, **options):
    return sorted(tuple(r) for r in rs.ranked_search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect())


def test_odd_rows_equal_the_plain_search(spark):
    rows = [*repeated(odd_rows()), (None, "alpha1 one two"), (99_000, "one ONE Öne öne one"), (99_001, "one-one_one")]
    base = [t for _, t in rows if t]
    rng = random.Random(1)
    items = [(k, " ".join(rng.choices(rng.choice(base).split(), k=rng.randrange(1, 30)))) for k in range(40)]
    many = " ".join(f"passage{k} alpha{k} beta{k % 50}" for k in range(100))  # more terms than one mask word holds
    items += [(100, None), (101, ""), (102, "!?"), (None, "one"), (103, "nowhere-at-all"), (104, "one one two"), (104, "alpha1"), (105, many), (105, many)]
    docs = documents(spark, rows, CLASH)
    expected = plain(rows, items)
    assert search(docs, benchmark(spark, items)) == expected
    assert search(docs.coalesce(1), benchmark(spark, items), item_bytes=500) == expected  # items in many blocks
    assert search(docs, benchmark(spark, items), top=3) == plain(rows, items, 3)
    assert search(docs.limit(0), benchmark(spark, items)) == []
    assert search(docs, benchmark(spark, items).limit(0)) == []
    assert search(docs.where("text is null"), benchmark(spark, items)) == []


def test_small_blocks_and_steps_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(4_000)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(700)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for k in range(25)]
    for docs, step in ((16_384, 1), (1, 64)):
        monkeypatch.setattr(rs, "BLOCK_DOCS", docs)
        monkeypatch.setattr(rs, "FIRST_STEP", step)
        assert search(documents(spark, rows), benchmark(spark, items)) == plain(rows, items)


def test_groups_by_mask():
    docs, first, masks = rs.presence_groups([np.array([0, 2, 5]), np.array([2, 3, 5])], 7)
    groups = {tuple(m): sorted(docs[a:b].tolist()) for m, a, b in zip(masks.tolist(), first, [*first[1:], len(docs)])}
    assert groups == {(True, False): [0], (False, True): [3], (True, True): [2, 5]}


def test_a_term_is_its_bytes(monkeypatch):
    vocabulary = rs.Vocabulary([b"ab", b"cd", b"abc"])
    data = np.frombuffer(b"cd ab xy abc", dtype=np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12])
    assert vocabulary.find(data, start, end).tolist() == [1, 0, -1, 2]
    keys = vocabulary.hash.ranges(data, start, end)
    keys[2] = keys[1]  # another string with a term's hash
    monkeypatch.setattr(vocabulary.hash, "ranges", lambda *_: keys)
    assert vocabulary.find(data, start, end).tolist() == [1, 0, -1, 2]
