import re

from flowdetect.llm.quality_rules import MAX_LINE_CHAR_PERCENT, MAX_NGRAM_PERCENT, quality_rules
from tests.llm.cases import CLASH, by_id, documents, odd_rows, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in lines:
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, WORD.findall(line)))
        seen.add(line)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    chars = sum(map(len, words))
    failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
    kept = not failed and 100 * dup_chars <= MAX_LINE_CHAR_PERCENT * chars
    for n, percent in MAX_NGRAM_PERCENT.items():
        before, inside = set(), set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in before:
                inside.update(range(i, i + n))
            before.add(tuple(words[i : i + n]))
        kept = kept and 100 * sum(len(words[j]) for j in inside) <= percent * chars
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), dup_lines, len(repeat), failed, kept


def test_counts_and_verdict_equal_the_plain_rules(spark):
    rows = repeated(odd_rows())
    docs = documents(spark, rows, CLASH)
    out = quality_rules(docs)
    assert out.count() == len(rows)
    got = by_id(out)
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == plain(text), (i, text)
    assert quality_rules(docs.limit(0)).count() == 0


def test_one_text_larger_than_a_slice(spark):
    text = "some words of one very long text without repeats " + " ".join(f"w{k}" for k in range(300_000))
    r = quality_rules(documents(spark, [(1, text), (2, "short"), (None, None)])).where("doc_id = 1").first()
    assert (r["n_words"], r["kept"]) == (len(text.split()), True)


def test_swapped_strings_are_two_lines(spark):
    from tests.llm.test_minhash import swapped_texts

    one, other = swapped_texts()
    got = by_id(quality_rules(documents(spark, [(1, f"{one}\n{other}"), (2, f"{one}\n{one}")])))
    assert (got[1]["n_dup_lines"], got[2]["n_dup_lines"]) == (0, 1)
