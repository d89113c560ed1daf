"""Small inputs with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pyarrow.dataset as ds

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample_texts(n=60):
    table = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pandas().sort_values("doc_id")
    return table["text"].tolist()[:n]


def odd_rows():
    """Rows (doc_id, text) with the odd cases, ids unique but for repeated rows at the end."""
    base = sample_texts(40)
    rng = random.Random(5)
    long_words = " ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "epsilon."]) + str(rng.randrange(900)) for _ in range(9_000))
    passage = " ".join(f"passage{k}" for k in range(70))
    texts = [
        *base, None, "", " \t\n", "one", "one", "two words", "a b c", "a b c d", "a  b\tc d", "A B C D", long_words, long_words + " tail",
        "x" * 5_000, "na " * 400, "line one here\nline two here\n" * 30, "é ü  wide  space", "tail<|endoftext|> end", "½ half ½",
        f"First {base[3]} {passage}", f"Second {base[7]} {passage} the end", "\x00nul\x1f byte", "emoji 😀 😀 text", base[0], base[0] + " more",
        base[5].upper() if base[5] else "UP",
    ]
    rows = [(1000 + 7 * k, t) for k, t in enumerate(texts)]
    return rows


def repeated(rows):
    return rows + [rows[2], rows[2], rows[44]]


def documents(spark, rows, extra=()):
    """A documents table; ``extra`` names further columns, of names that the operators use themselves."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *extra]
    schema = SCHEMA + "".join(f", `{c}` string" for c in extra)
    data = [(i, t, None if k % 5 == 0 else "en", "src", len(t or ""), *(f"{c}{k}" for c in extra)) for k, (i, t) in enumerate(rows)]
    assert len(names) == 5 + len(extra)
    return spark.createDataFrame(data, schema).repartition(3)


CLASH = ("shard", "slot", "digest", "hash", "id", "tag", "component", "node", "key", "length", "block", "score", "kept", "_row", "_text", "start")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
