import os
import shutil
import subprocess
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowdetect.llm import oracle, queries
from flowdetect.llm.common import read_table, stored
from flowdetect.llm.packing import END_ID
from flowdetect.llm.quality_classifier import classify
from tests.llm.cases import SF, documents, odd_rows, repeated
from tests.llm.test_exact_dedup import normal
from tests.llm.test_minhash import plain

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF01 = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, by name; the documents under ''."""
    docs = read_table(spark, SF01, "documents")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF01), f"test-{name}")
    return out


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "passages", "packing"]
    columns = stages[""].columns
    assert all(stages[name].columns == columns for name in ("quality", "exact", "near", "passages"))


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    accepted = classify(stages[""], read_table(spark, SF01, "labels")).where("predicted = 1").select("doc_id")
    assert sorted(r["doc_id"] for r in stages["quality"].collect()) == sorted(r["doc_id"] for r in accepted.collect())
    good = read_table(spark, SF01, "labels").where("quality = 1").count()
    kept = stages["quality"].join(read_table(spark, SF01, "labels").where("quality = 1"), "doc_id").count()
    assert kept >= 0.98 * good


def test_exact_keeps_the_first_of_equal_texts(stages):
    first = {}
    for r in stages["quality"].collect():
        first[normal(r["text"])] = min(r["doc_id"], first.get(normal(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in stages["exact"].collect()) == sorted(first.values())


def test_near_keeps_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["exact"].collect()]
    top = {}
    sets = {}
    from tests.llm.test_minhash import shingles

    for i, t in rows:
        sets[i] = shingles(t, 5)
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    assert sorted(r["doc_id"] for r in stages["near"].collect()) == sorted(i for i in top if top[i] == i)


def test_passages_only_cut_repeats(stages):
    before = {r["doc_id"]: r["text"] for r in stages["near"].collect()}
    seen, repeats = set(), set()
    for i in sorted(before):
        words = before[i].lower().split()
        windows = {tuple(words[k : k + 60]) for k in range(len(words) - 59)}
        if windows & seen:
            repeats.add(i)
        seen |= windows
    after = {r["doc_id"]: r for r in stages["passages"].collect()}
    for i, text in before.items():
        left = after[i]["text"] if i in after else ""
        if i in repeats:
            assert len(left) < len(text)
        if len(left) < len(text):
            rest = iter(text)
            assert all(c in rest for c in left) and (i not in after or after[i]["n_chars"] == len(left))
        else:
            assert left == text


def test_packing_places_every_id_once(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.PACKING_VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = {}
    for r in stages["packing"].collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    docs = {r["doc_id"]: r["text"] for r in stages["passages"].collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids + [END_ID])
        at = 0
        for start, length in sorted(got[i]):
            assert start == at
            at += length
        assert at == n


def test_run_applies_the_stages(spark, stages):
    out = corpus_pipeline.run(spark, SF01)
    assert out.columns == stages["packing"].columns and out.count() == stages["packing"].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark):
    docs = documents(spark, repeated(odd_rows()) + [(None, "a row without an id"), (None, None)])
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns


def test_queries_and_sql_have_the_same_names():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert set(oracle.oracle_sql()) <= names


def test_the_rest_works_without_this_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flow_stats' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_components_of_a_pair_table_match_the_brute_force():
    top, sizes = plain([(1, "a b c d e"), (2, "a b c d e"), (3, "x")], 4)
    assert top == {1: 1, 2: 1, 3: 3} and sizes == [(1, 2), (2, 2), (3, 1)]
