import random
import re

import numpy as np
import pyarrow.dataset as ds

from flowdetect.llm import substring_dedup
from flowdetect.llm.substring_dedup import MIN_WORDS, PrefixMax, _equal_run, _similarity, _skip, aligned, alike, chains, remove_passages, repeated_passages
from tests.llm.cases import CLASH, documents, odd_rows, repeated


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(3_000)}" for _ in range(n)]


def planted(rng):
    """Documents of own words, some with a passage of 60 to 200 words; edited in the later copy."""
    rows, spans = [], []
    passages = [prose(rng, n) for n in (60, 80, 120, 200)]
    for k in range(40):
        words = prose(rng, 150 + rng.randrange(100))
        if k % 2:
            passage = list(passages[k // 2 % 4])
            for _ in range(len(passage) // 60 if k // 2 >= 4 else 0):
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = passage
            if k // 2 >= 4:
                spans.append((k, at, len(passage)))
        rows.append((k, " ".join(words)))
    return rows, spans


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rows, spans = planted(random.Random(8))
    out = repeated_passages(documents(spark, rows, CLASH)).collect()
    text = dict(rows)
    found = {}
    for r in out:
        assert (r["source_doc_id"], r["source_start"]) < (r["doc_id"], r["start"]) and r["similarity"] >= 0.8 and r["n_words"] >= 50
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
        assert r["doc_id"] % 2 and r["source_doc_id"] % 2
    for doc, at, n in spans:
        words = text[doc].split(" ")
        begin = len(" ".join(words[:at])) + 1
        passage = len(" ".join(words[at : at + n]))
        covered = sum(b in found.get(doc, ()) for b in range(begin, begin + passage))
        assert covered > 0.85 * passage, (doc, at, n, covered, passage)
    for doc, cover in found.items():
        assert len(cover) < 1.2 * max(len(" ".join(text[doc].split(" ")[at : at + n])) for d, at, n in spans if d == doc)


def test_later_copies_are_cut_out(spark):
    rows, spans = planted(random.Random(9))
    docs = documents(spark, rows, CLASH)
    out = remove_passages(docs)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r for r in out.collect()}
    cut = {doc for doc, _, _ in spans}
    assert set(left) == {i for i, _ in rows}
    for i, text in rows:
        if i in cut:
            assert len(left[i]["text"]) < len(text) and left[i]["n_chars"] == len(left[i]["text"])
        else:
            assert left[i]["text"] == text


def test_odd_rows(spark):
    rows = repeated(odd_rows()) + [(None, "no id"), (None, odd_rows()[4][1])]
    docs = documents(spark, rows, CLASH)
    out = remove_passages(docs).collect()
    by_text = {r["text"] for r in out}
    assert None in by_text and "" in by_text and "one" in by_text
    found = repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found} >= {1000 + 7 * k for k, (_, t) in enumerate(odd_rows()) if t and t.endswith(" tail")}
    assert remove_passages(docs.limit(0)).count() == 0 and repeated_passages(docs.limit(0)).count() == 0


def test_a_copy_loses_its_row_and_the_first_stays(spark):
    text = " ".join(prose(random.Random(1), 300))
    out = remove_passages(documents(spark, [(5, text), (3, text), (9, "other"), (5, text)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(3, text), (9, "other")]


def test_prefix_max_equals_a_scan():
    rng = random.Random(3)
    tree, values = PrefixMax(50), [-1e18] * 50
    for item in range(300):
        place, value = rng.randrange(50), rng.random()
        tree.put(place, value, item)
        values[place] = max(values[place], value)
        bound = rng.randrange(51)
        assert tree.best(bound)[0] == max(values[:bound], default=-1e18)


def test_chains_follow_order_in_both_texts():
    x = np.array([0, 60, 130, 200, 260, 5_000, 5_060])
    y = np.array([1_000, 1_060, 1_130, 90, 1_262, 3_000, 3_060])
    out = [c.tolist() for c in chains(x, y)]
    assert out[0] == [0, 1, 2, 4] and [5, 6] in out and [3] in out


def test_alignment_passes_small_edits():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate([a[:40], [999], a[41:70], a[71:]]).astype(np.uint64)
    ((a0, a1, b0, b1, similarity),) = aligned(a, b, [(10, 10)])
    assert (a0, a1, b0, b1) == (0, 100, 0, 99) and 0.8 <= similarity < 1
    assert aligned(a[:40], a[:40], [(3, 3)]) == []


def pairs_with(rng, passages):
    """Rows: for each passage (its earlier and its later words) two documents of own words around it."""
    rows = []
    for k, (one, other) in enumerate(passages):
        rows += [(2 * k, " ".join(prose(rng, 60) + one + prose(rng, 60))), (2 * k + 1, " ".join(prose(rng, 60) + other + prose(rng, 60)))]
    return rows


def test_words_of_many_bytes(spark):
    rng = random.Random(21)
    passages = [["".join(rng.choice("абвгдежзиклмнопр") for _ in range(15)) for _ in range(50)] for _ in range(30)]
    found = repeated_passages(documents(spark, pairs_with(rng, [(p, p) for p in passages]))).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 60, 2))


def test_an_edit_anywhere_in_a_short_passage(spark):
    rng = random.Random(22)
    passages = []
    for k in range(100):
        words = prose(rng, 50)
        passages.append((words, [*words[: 15 + k % 20], "edited", *words[16 + k % 20 :]]))
    found = repeated_passages(documents(spark, pairs_with(rng, passages))).collect()
    assert {r["doc_id"] for r in found if r["similarity"] < 1 and r["n_words"] >= 50} == set(range(1, 200, 2))


def made_of_phrases(rng, edited):
    """Rows: pairs of documents (from 20,000 and from 30,000 on) sharing 70 words, of which nine earlier ones hold stretches of 30."""
    rows = []
    for k in range(10):
        words = prose(rng, 70)
        for m in range(9):
            rows.append((1_000 * m + k, " ".join(prose(rng, 60) + words[20 * (m % 3) :][:30] + prose(rng, 60))))
        later = [*words[:35], "edited", *words[36:]] if edited else words
        rows += [(20_000 + k, " ".join(prose(rng, 60) + words + prose(rng, 60))), (30_000 + k, " ".join(prose(rng, 60) + later + prose(rng, 60)))]
    return rows


def test_passages_made_of_frequent_phrases(spark):
    for edited in (False, True):
        found = repeated_passages(documents(spark, made_of_phrases(random.Random(23), edited))).collect()
        assert {(r["doc_id"], r["source_doc_id"]) for r in found} == {(30_000 + k, 20_000 + k) for k in range(10)}
        assert all(r["n_words"] >= 70 for r in found)


def test_a_phrase_used_before_in_the_document(spark):
    rng = random.Random(24)
    rows = []
    for k in range(10):
        words = prose(rng, 60)
        phrases = [w for a in (0, 20, 30) for w in prose(rng, 5) + words[a : a + 30]]
        rows += [(k, " ".join(phrases + prose(rng, 60) + words)), (100 + k, " ".join(phrases[::-1] + phrases + prose(rng, 60) + words))]
    found = repeated_passages(documents(spark, rows)).collect()
    assert {r["doc_id"] for r in found if r["n_words"] >= 60 and r["source_doc_id"] == r["doc_id"] - 100} == set(range(100, 110))


def test_a_near_equal_part_beside_a_revised_one():
    a = np.arange(199, dtype=np.uint64)
    b = a.copy()
    b[[49, *range(99, 199, 8)]] = np.arange(1_000, 1_014)
    ((a0, a1, b0, b1, similarity),) = aligned(a, b, [(10, 10)])
    assert (a0, b0) == (0, 0) and a1 == b1 >= 99 and 0.8 <= similarity < 1


def test_parts_equal_a_search_of_all():
    rng = random.Random(25)
    some = 0
    for _ in range(40):
        a = np.arange(400, dtype=np.uint64)
        b = a.copy()
        cuts = sorted(rng.sample(range(1, 399), rng.randrange(4, 30)))
        b[cuts] = np.arange(1_000, 1_000 + len(cuts))
        edges = [-1, *cuts, 400]
        runs = [(p + 1, p + 1, q - p - 1) for p, q in zip(edges, edges[1:]) if q > p + 1]
        good = []
        for s, (x, _, _) in enumerate(runs):
            for e in range(s, len(runs)):
                end = runs[e][0] + runs[e][2]
                own = {tuple(a[k : k + 5]) for k in range(x, end - 4)}
                other = {tuple(b[k : k + 5]) for k in range(x, end - 4)}
                if end - x >= 50 and 10 * len(own & other) >= 8 * len(own | other):
                    good.append((x, end))
        longest = [g for g in good if not any(h != g and h[0] <= g[0] and g[1] <= h[1] for h in good)]
        assert [(a0, a1) for a0, a1, *_ in alike(a, b, runs)] == longest
        some += len(longest)
    assert some > 20


def test_edited_passages_of_which_earlier_documents_hold_every_phrase(spark):
    rng = random.Random(26)
    rows = []
    for k in range(10):
        words = prose(rng, 70)
        for m, start in enumerate([0, 5, 10, 15, 20, 21] * 3):  # phrases of 49 words, each in three documents
            rows.append((1_000 * k + m, " ".join(prose(rng, 40) + words[start : start + 49] + prose(rng, 40))))
        rows += [(20_000 + k, " ".join(prose(rng, 60) + words + prose(rng, 60))), (30_000 + k, " ".join(prose(rng, 60) + [*words[:35], "edited", *words[36:]] + prose(rng, 60)))]
    found = repeated_passages(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in found} == {(30_000 + k, 20_000 + k) for k in range(10)}


def repeated_windows(rows):
    """By brute force: (doc, word) of all windows of MIN_WORDS words that agree, place by place, with an earlier window in 41 of their 46 shingles
    (similarity 0.8 or more) and in their first and last word; and the byte ranges of each document's words."""
    ranges, words_of, seen, covered = {}, {}, {}, set()
    for doc, text in sorted(rows):
        data = (text or "").encode()
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", data))
        words = words_of[doc] = [m.group().lower() for m in found]
        ranges[doc] = [m.span() for m in found]
        hits = {}
        for k in range(len(words) - 4):
            shingle = tuple(words[k : k + 5])
            for source, at in seen.setdefault(shingle, []):
                if source < doc or k - at >= MIN_WORDS:
                    hits.setdefault((source, k - at), []).append(k)
            seen[shingle].append((doc, k))
        for (source, lag), at in hits.items():
            shared = np.zeros(len(words), dtype=np.int64)
            shared[at] = 1
            count = np.concatenate([[0], np.cumsum(shared)])
            for p in range(max(0, lag), min(len(words), len(words_of[source]) + lag) - MIN_WORDS + 1):
                ends = all(words[q] == words_of[source][q - lag] for q in (p, p + MIN_WORDS - 1))
                if ends and count[p + 46] - count[p] >= 41:
                    covered.update((doc, q) for q in range(p, p + MIN_WORDS))
    return covered, ranges


def test_recall_against_all_windows(spark):
    table = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"]).to_pandas()
    rows = [(int(i), t) for i, t in zip(table["doc_id"], table["text"])]
    true, ranges = repeated_windows(rows)
    found = repeated_passages(documents(spark, rows)).collect()
    got = {(r["doc_id"], q) for r in found for q, (a, b) in enumerate(ranges[r["doc_id"]]) if r["start"] <= a and b <= r["end"]}
    assert len(true) > 10_000 and len(true & got) >= 0.99 * len(true), (len(true), len(true & got))
    text = dict(rows)

    def shingles(doc, a, b):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text[doc].encode()[a:b].lower())
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    for r in found:
        own, other = shingles(r["doc_id"], r["start"], r["end"]), shingles(r["source_doc_id"], r["source_start"], r["source_end"])
        assert len(own & other) >= 0.8 * len(own | other) - 1e-9 and (r["source_doc_id"], r["source_start"]) < (r["doc_id"], r["start"])


def test_no_passage_is_its_own_copy(spark):
    rng = random.Random(27)
    rows = [(k, " ".join(rng.choice(["auf", "auf", "auf", "nicht", "der"]) for _ in range(150))) for k in range(20)]
    found = repeated_passages(documents(spark, rows)).collect()
    assert all((r["source_doc_id"], r["source_start"], r["source_end"]) < (r["doc_id"], r["start"], r["end"]) for r in found)
    left = {r["doc_id"]: r["text"] for r in remove_passages(documents(spark, rows)).collect()}
    assert left[0].startswith(rows[0][1][:20])
    b = np.array([1, 2, 1, 2, 1, 2, 1, 1] * 20, dtype=np.uint64)
    for a0, a1, b0, b1, _ in aligned(b[3:], b, [(20, 20)], 3):
        assert a0 + 3 > b0 and a1 + 3 > b1


def test_skips_equal_a_search_of_all():
    rng = random.Random(28)
    for _ in range(3_000):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(9))] for _ in range(2))
        if a and b and a[0] == b[0]:
            continue
        ways = [(i + j, i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        assert _skip(np.array(a, np.uint64), np.array(b, np.uint64)) == (min(ways)[1:] if ways else None)
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert _equal_run(np.array(a, np.uint64), np.array(b, np.uint64)) == n
    long = np.arange(5_000, dtype=np.uint64)
    for at in (63, 64, 319, 320, 4_999):
        other = long.copy()
        other[at] = 9_999
        assert _equal_run(long, other) == at


def test_equal_stretches_and_runs_without_a_passage_cost_no_search(monkeypatch):
    words = np.arange(1, 400, dtype=np.uint64)
    other = words.copy()
    other[::4] += np.uint64(10_000)
    runs = [(at, at, 3) for at in range(1, 396, 4)]  # every fourth word differs: no shingle in common
    assert _similarity(words[:60], words[5:65]) == 51 / 61

    def searched(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(substring_dedup, "_shingles", searched)
    monkeypatch.setattr(substring_dedup.np, "flatnonzero", searched)
    assert _similarity(words, words.copy()) == 1.0
    assert alike(words, other, runs) == []
    assert alike(words, words, [(0, 0, 20), (25, 25, 20)]) == []  # too short together


def test_similarity_is_that_of_the_shingle_sets():
    rng = random.Random(31)
    for _ in range(300):
        a, b = ([rng.randrange(2) for _ in range(rng.randrange(20))] for _ in range(2))
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b)]
        expected = len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))
        assert _similarity(np.array(a, np.uint64), np.array(b, np.uint64)) == expected
