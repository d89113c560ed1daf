import hashlib
import re

from flowdetect.llm.exact_dedup import DigestIndex, exact_dedup, keep_rows
from tests.llm.cases import CLASH, documents, odd_rows, repeated


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_groups_of_equal_texts(spark):
    rows = repeated(odd_rows()) + [(5, "same  here"), (3, "same\there"), (None, "same here"), (None, "only nulls"), (None, "only nulls")]
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted(
        (str(i), str(keep[normal(t)]), len(groups[normal(t)]), i == keep[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows
    )
    out = exact_dedup(documents(spark, rows, CLASH)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in out) == expected


def test_index_persists_between_batches(spark, scratch):
    path = scratch("index")
    first = DigestIndex(spark, path, buckets=4)
    assert keep_rows(documents(spark, [(9, "a b"), (4, "c"), (7, "a  b")]), first).count() == 2
    first.drop_entry()
    again = DigestIndex(spark, path, buckets=4)  # another session would open it the same way
    kept = keep_rows(documents(spark, [(1, "a b"), (2, "new"), (3, "new"), (8, None)]), again)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "new"), (8, None)]
    assert again.entries().count() == 4
    assert {r["keep_id"] for r in again.entries().collect()} == {7, 4, 2, 8}
    # a text that comes again has the id and the count of the batch that brought it
    later = exact_dedup(documents(spark, [(1, "a b"), (2, "a b"), (3, "a b"), (5, "other")]), again).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in later) == [(1, 7, 2, False), (2, 7, 2, False), (3, 7, 2, False), (5, 5, 1, True)]
    again.drop_entry()


def test_anti_join_reads_the_index_by_bucket(spark, scratch):
    index = DigestIndex(spark, scratch("index"), buckets=4)
    index.add(spark.createDataFrame([(1, bytearray(b"x"))], "doc_id long, digest binary"))
    known = spark.table(index.table).select("digest")
    new = spark.createDataFrame([(bytearray(b"y"),)], "digest binary").groupBy("digest").count()
    plan = new.join(known.hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.drop_entry()


def test_kept_rows_keep_their_columns(spark):
    rows = repeated(odd_rows())
    docs = documents(spark, rows, CLASH)
    kept = keep_rows(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len({normal(t) for _, t in rows}) == len({normal(r["text"]) for r in got})
    assert keep_rows(docs.limit(0)).count() == 0 and exact_dedup(docs.limit(0)).count() == 0
