"""DuckDB SQL for the operators that SQL can express (same columns as the queries)."""

from __future__ import annotations

from flowdetect.llm.quality_rules import MAX_BASE_REPEAT_PERCENT, MAX_LINE_CHAR_PERCENT, MAX_NGRAM_PERCENT, MIN_WORDS, SYMBOLS


def oracle_sql() -> dict[str, str]:
    return {
        "op1_superminhash_dedup": NEAR_DUPLICATES,
        "op4_exact_dedup": EXACT_DEDUP,
        "op5_quality_rules": quality_rules_sql(),
        "op10_radix_suffix_dedup": REPEATED_STRINGS,
        "op13_presence_mask_search": RANKED_SEARCH,
    }


# All pairs that share a shingle, links on whole sets, reachability.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS shared
  FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT u, v FROM pairs WHERE 100 * shared >= 80 * (nu + nv - shared)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT e.v, r.c FROM reach r JOIN edges e ON e.u = r.doc_id
), top AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, t.component_id, s.doc_id = t.component_id AS kept
FROM sets s JOIN top t USING (doc_id)
"""

# Every string of 100 bytes (as 200 hex digits), its first place, and what later ones cover.
REPEATED_STRINGS = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS MATERIALIZED (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM raw)
), again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM strings) WHERE k > 1), marked AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER w + 100 THEN 1 ELSE 0 END AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run
), pieces AS (
  SELECT r.doc_id, r.a, substr(w.h, 2 * coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) + 1,
                               2 * (r.a - coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0))) AS part
  FROM runs r JOIN raw w USING (doc_id)
), heads AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS head FROM pieces GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last FROM runs GROUP BY doc_id)
SELECT r.doc_id, CAST(len(r.h) // 2 AS BIGINT) AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(h.head, '') || substr(r.h, 2 * coalesce(s.last, 0) + 1))) AS kept_sha256
FROM raw r LEFT JOIN sums s USING (doc_id) LEFT JOIN heads h USING (doc_id)
"""


def quality_rules_sql() -> str:
    """Counts by listing every word, line and window; the verdict from the operator's own thresholds."""
    lengths = sorted(MAX_NGRAM_PERCENT)

    def gram(n: int) -> str:
        return " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, n))])

    windows = ",\n".join(
        f"""grams_{n} AS (SELECT doc_id, k, {gram(n)} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
again_{n} AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, g ORDER BY k) AS r FROM grams_{n} WHERE g IS NOT NULL) WHERE r > 1),
inside_{n} AS (SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS k FROM again_{n}),
chars_{n} AS (SELECT doc_id, sum(len(w))::BIGINT AS c FROM inside_{n} JOIN words USING (doc_id, k) GROUP BY doc_id)"""
        for n in lengths
    )
    joins = " ".join(f"LEFT JOIN chars_{n} USING (doc_id)" for n in lengths)
    columns = ", ".join(f"coalesce(chars_{n}.c, 0) AS repeat_chars_{n}" for n in lengths)
    passes = " AND ".join(f"100 * repeat_chars_{n} <= {p} * word_chars" for n, p in MAX_NGRAM_PERCENT.items())
    symbols = " + ".join(f"len(t) - len(replace(t, '{c}', ''))" for c in SYMBOLS.decode())
    return rf"""
WITH lists AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM lists),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM lists),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS r FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r > 1) AS n_dup_lines,
    coalesce(sum(len(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (r > 1), 0)::BIGINT AS dup_line_chars FROM full_lines GROUP BY doc_id),
{windows},
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams_5 WHERE g IS NOT NULL) WHERE c > 1),
repeat_words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS k FROM twice) GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS n_words, sum(len(w))::BIGINT AS word_chars FROM words GROUP BY doc_id),
counts AS (SELECT l.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    CAST({symbols} AS BIGINT) AS n_symbols, coalesce(c.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    coalesce(c.dup_line_chars, 0) AS dup_line_chars, coalesce(c.n_lines, 0) AS n_lines, {columns}
  FROM lists l LEFT JOIN totals USING (doc_id) LEFT JOIN line_counts c USING (doc_id) LEFT JOIN repeat_words r USING (doc_id) {joins}),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_BASE_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {MAX_LINE_CHAR_PERCENT} * word_chars AND {passes} AS kept FROM judged
"""


EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

# Every item against every document that holds one of its terms.
RANKED_SEARCH = r"""
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM found),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM found) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items) GROUP BY item_id, term
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
sizes AS (SELECT r, doc_id, CAST(100 - 25 + (25 * len(t) * n_docs) // n_terms AS BIGINT) AS m FROM found, totals WHERE len(t) > 0 AND doc_id IS NOT NULL),
scores AS (
  SELECT a.item_id, f.r, s.doc_id, CAST(sum(a.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * s.m))) AS BIGINT) AS score
  FROM asked a JOIN weights w USING (term) JOIN tf f USING (term) JOIN sizes s USING (r) GROUP BY a.item_id, f.r, s.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
