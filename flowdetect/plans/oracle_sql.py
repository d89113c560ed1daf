"""DuckDB SQL that computes the same results as the registered queries.

Each statement runs on the pre-registered test views (``events`` etc.) and
builds the flow table with the same derivation as ``flows_from_events``.
Column names equal the Spark query's, so results compare column by column.
"""

from __future__ import annotations

from flowdetect.schema import FLOW_COLS, LONG_COLS

FLOWS_CTE = """flows AS (
  SELECT event_id,
    concat('Jun', CAST(12 + day(ts) % 6 AS VARCHAR)) AS day,
    CASE WHEN (event_type = 'error' AND value > 10) OR event_id % 50 = 0 THEN 'Attack' ELSE 'Normal' END AS Tag,
    CASE event_type WHEN 'click' THEN 'HTTPWeb' WHEN 'view' THEN 'HTTPImageTransfer'
      WHEN 'error' THEN 'SSH' WHEN 'signup' THEN 'DNS' ELSE 'IRC' END AS appName,
    concat('10.', CAST(user_id % 5 AS VARCHAR), '.0.', CAST(event_id % 200 AS VARCHAR)) AS destination,
    CAST(CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 80 WHEN 'error' THEN 22
      WHEN 'signup' THEN 53 ELSE 6667 END AS BIGINT) AS destinationPort,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 < 4 THEN 'S,P,A' ELSE 'F,S,A' END
      AS destinationTCPFlagsDescription,
    CASE event_id % 3 WHEN 0 THEN 'L2R' WHEN 1 THEN 'L2L' ELSE 'R2L' END AS direction,
    CASE WHEN event_type = 'signup' THEN 'udp_ip' ELSE 'tcp_ip' END AS protocolName,
    concat(CAST(131 + user_id % 40 AS VARCHAR), '.202.', CAST(user_id % 8 AS VARCHAR), '.',
      CAST(user_id % 200 AS VARCHAR)) AS source,
    CAST(1024 + event_id % 4096 AS BIGINT) AS sourcePort,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'S,A' END AS sourceTCPFlagsDescription,
    concat(substring(CAST(ts AS VARCHAR), 1, 10), 'T', substring(CAST(ts AS VARCHAR), 12, 8)) AS startDateTime,
    concat(substring(CAST(ts + INTERVAL 90 SECOND AS VARCHAR), 1, 10), 'T',
      substring(CAST(ts + INTERVAL 90 SECOND AS VARCHAR), 12, 8)) AS stopDateTime,
    CAST(floor(value * 100) AS BIGINT) AS totalDestinationBytes,
    CAST(event_id % 7 AS BIGINT) AS totalDestinationPackets,
    CAST(floor(value * 10) AS BIGINT) AS totalSourceBytes,
    CAST(event_id % 5 AS BIGINT) AS totalSourcePackets
  FROM events
)"""

TEXT_COLS = [c for c in FLOW_COLS if c not in LONG_COLS]


def _prefix(expr: str) -> str:
    return f"array_to_string(list_slice(string_split(rtrim({expr}, '.'), '.'), 1, 2), '.')"


def _filled(c: str) -> str:
    return f"coalesce({c}, 'N/A')" if c in TEXT_COLS else c


def _coarse(c: str) -> str:
    if c in ("destination", "source"):
        return _prefix(_filled(c))
    if c in ("startDateTime", "stopDateTime"):
        return f"substring({_filled(c)}, 12, 2)"
    return _filled(c)


FILLED_CTE = "filled AS (\n  SELECT event_id, day, " + ", ".join(
    f"{_filled(c)} AS {c}" for c in FLOW_COLS
) + "\n  FROM flows\n)"

COARSE_CTE = "coarse AS (\n  SELECT event_id, day, " + ", ".join(
    f"{_coarse(c)} AS {c}" for c in FLOW_COLS
) + "\n  FROM flows\n)"

# Text features in flow order (Tag excluded), and integer features.
TEXT_FEATURES = [c for c in TEXT_COLS if c != "Tag"]
LONG_FEATURES = [c for c in FLOW_COLS if c not in TEXT_COLS]
FEATURES = TEXT_FEATURES + LONG_FEATURES


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _index_cte(scope_by_day: bool = False) -> str:
    """Frequency rank of every text value per column: most frequent 0, ties by value."""
    part = "day, " if scope_by_day else ""
    unions = "\n    UNION ALL ".join(
        f"SELECT {part}'{c}' AS feature, {c} AS value FROM coarse" for c in ["Tag", *TEXT_FEATURES]
    )
    pby = "PARTITION BY day, feature" if scope_by_day else "PARTITION BY feature"
    return f"""vals AS (
    {unions}
),
freq AS (
  SELECT {part}feature, value, count(*) AS n FROM vals GROUP BY ALL
),
ranked AS (
  SELECT {part}feature, value, n,
    CAST(row_number() OVER ({pby} ORDER BY n DESC, value) - 1 AS DOUBLE) AS idx
  FROM freq
)"""


def _slots_cte(by_day: bool = False) -> str:
    """One row per (event, slot): assembled value, then its re-coded value.

    Slots with at most 10 distinct values are re-coded: 0 keeps code 0, the
    other values take 1.. (or 0..) in ascending order. ``by_day``: indices and
    slot statistics are per day (each day's own preparation).
    """
    d = "c.day, " if by_day else ""
    on_day = " AND r.day = c.day" if by_day else ""
    text_rows = "\n    UNION ALL ".join(
        f"SELECT {d}c.event_id, {i} AS slot, r.idx AS value FROM coarse c "
        f"JOIN ranked r ON r.feature = '{f}' AND r.value = c.{f}{on_day}"
        for i, f in enumerate(TEXT_FEATURES)
    )
    long_rows = "\n    UNION ALL ".join(
        f"SELECT {d}c.event_id, {len(TEXT_FEATURES) + i} AS slot, CAST(c.{f} AS DOUBLE) AS value FROM coarse c"
        for i, f in enumerate(LONG_FEATURES)
    )
    g = "day, " if by_day else ""
    return f"""slots AS (
    {text_rows}
    UNION ALL {long_rows}
),
slot_values AS (
  SELECT {g}slot, value FROM slots GROUP BY {g}slot, value
),
slot_stats AS (
  SELECT {g}slot, count(*) AS n_distinct, bool_or(value = 0) AS has_zero FROM slot_values GROUP BY {g}slot
)"""


def _recode_cte() -> str:
    """The vector indexer's code of every (slot, value), over all rows."""
    return """recode AS (
  SELECT v.slot, v.value,
    CASE WHEN s.n_distinct > 10 THEN v.value
         WHEN v.value = 0 THEN 0.0::DOUBLE
         ELSE CAST(v.nz_rank - CASE WHEN s.has_zero THEN 0 ELSE 1 END AS DOUBLE) END AS indexed_value
  FROM (SELECT slot, value, row_number() OVER (PARTITION BY slot, value = 0 ORDER BY value) AS nz_rank
        FROM slot_values) v
  JOIN slot_stats s ON s.slot = v.slot
)"""


def _split_expr(key: str = "event_id", threshold: str = "b3333333") -> str:
    return f"CASE WHEN substring(md5(CAST({key} AS VARCHAR)), 1, 8) < '{threshold}' THEN 'train' ELSE 'test' END"


def _stump_ctes() -> list[str]:
    """The one-split tree of each scope (each day, and all days): best split, leaves, scored test rows.

    Values of a nominal feature are ordered by their count of the second label
    (ties by index), numbers by value; the split with the largest Gini gain wins, the lowest
    slot on a tie. Labels and indices count all rows of the scope, gains only training rows.
    """
    cols = ", ".join(FLOW_COLS)
    tag = "(SELECT scope, Tag, count(*) AS n FROM scoped GROUP BY scope, Tag)"
    text_values = "\n    UNION ALL ".join(f"SELECT scope, event_id, {i} AS slot, {c} AS text, NULL::BIGINT AS num FROM scoped" for i, c in enumerate(TEXT_FEATURES))
    long_values = "\n    UNION ALL ".join(
        f"SELECT scope, event_id, {len(TEXT_FEATURES) + i} AS slot, NULL AS text, {c} AS num FROM scoped" for i, c in enumerate(LONG_FEATURES)
    )
    gini = lambda a, n: f"(1 - power(({a})::DOUBLE / ({n}), 2) - power((({n}) - ({a}))::DOUBLE / ({n}), 2))"
    return [
        f"scoped AS (SELECT day AS scope, event_id, {cols} FROM coarse UNION ALL SELECT 'all' AS scope, event_id, {cols} FROM coarse)",
        f"labels AS (SELECT scope, Tag, row_number() OVER (PARTITION BY scope ORDER BY n DESC, Tag) - 1 AS y FROM {tag})",
        f"sides AS (SELECT c.scope, c.event_id, c.Tag, l.y, {_split_expr('c.event_id')} AS part FROM scoped c JOIN labels l USING (scope, Tag))",
        f"vals AS (\n    {text_values}\n    UNION ALL {long_values})",
        "domain AS (SELECT scope, slot, text, num, count(*) AS n_all FROM vals GROUP BY scope, slot, text, num)",
        f"""kinds AS (SELECT scope, slot, text, num, (slot < {len(TEXT_FEATURES)} OR count(*) OVER (PARTITION BY scope, slot) <= 10) AS nominal,
    row_number() OVER (PARTITION BY scope, slot ORDER BY CASE WHEN text IS NULL THEN 0 ELSE -n_all END, text, num) AS idx FROM domain)""",
        """counts AS (SELECT v.scope, v.slot, v.text, v.num, count(*) AS n, sum(s.y)::BIGINT AS n1
    FROM vals v JOIN sides s USING (scope, event_id) WHERE s.part = 'train' GROUP BY v.scope, v.slot, v.text, v.num)""",
        """placed AS (SELECT c.*, k.nominal, row_number() OVER (PARTITION BY c.scope, c.slot
    ORDER BY CASE WHEN k.nominal THEN c.n1 ELSE c.num END, k.idx) AS pos
    FROM counts c JOIN kinds k ON k.scope = c.scope AND k.slot = c.slot AND k.text IS NOT DISTINCT FROM c.text AND k.num IS NOT DISTINCT FROM c.num)""",
        """sums AS (SELECT *, sum(n) OVER w AS nl, sum(n1) OVER w AS al, sum(n) OVER t AS nt, sum(n1) OVER t AS atot, lead(num) OVER o AS next_num
    FROM placed WINDOW o AS (PARTITION BY scope, slot ORDER BY pos), w AS (PARTITION BY scope, slot ORDER BY pos ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY scope, slot))""",
        f"""gains AS (SELECT *, {gini('atot', 'nt')} - nl::DOUBLE / nt * {gini('al', 'nl')} - (nt - nl)::DOUBLE / nt * {gini('(atot - al)', '(nt - nl)')} AS gain
    FROM sums WHERE nl < nt)""",
        """best AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY scope ORDER BY round(gain, 12) DESC, slot, pos) = 1)""",
        """goes_left AS (SELECT p.scope, p.slot, p.text, p.num FROM placed p JOIN best b ON b.scope = p.scope AND b.slot = p.slot AND b.nominal AND p.pos <= b.pos)""",
        """leaves AS (SELECT s.scope, s.event_id, s.Tag, s.y, s.part,
    CASE WHEN b.nominal THEN g.slot IS NOT NULL ELSE v.num <= (b.num + b.next_num) / 2.0 END AS lft
    FROM sides s JOIN best b USING (scope) JOIN vals v ON v.scope = s.scope AND v.event_id = s.event_id AND v.slot = b.slot
    LEFT JOIN goes_left g ON g.scope = v.scope AND g.text IS NOT DISTINCT FROM v.text AND g.num IS NOT DISTINCT FROM v.num)""",
        """stump(scope, node, n0, n1) AS (
    SELECT scope, 0, count(*) FILTER (y = 0), count(*) FILTER (y = 1) FROM leaves WHERE part = 'train' GROUP BY scope
    UNION ALL SELECT scope, CASE WHEN lft THEN 1 ELSE 2 END, count(*) FILTER (y = 0), count(*) FILTER (y = 1) FROM leaves WHERE part = 'train' GROUP BY ALL)""",
        """predicted AS (SELECT l.scope, l.event_id, l.Tag, CAST(l.y AS DOUBLE) AS indexedLabel, CASE WHEN t.n1 > t.n0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
    FROM leaves l JOIN stump t ON t.scope = l.scope AND t.node = CASE WHEN l.lft THEN 1 ELSE 2 END WHERE l.part = 'test')""",
    ]


TREE_DEPTH = 3


def _tree_ctes(by_scope: str | None = None) -> list[str]:
    """A tree of three levels on all training rows and features, level by level (no recursion: depth is fixed).

    ``at<k>``: the node of every row at level k, as its path; ``best<k>``: each open node's best split. A node
    is open when its training rows are of both labels. Of equal gains the first slot and the first place
    count; thresholds lie half way to the next value of all training rows. ``tree``: the nodes that stay when
    splits whose sides are leaves of one prediction are undone, from below.
    """
    cols = ", ".join(FLOW_COLS)
    scopes = f"SELECT day AS scope, event_id, {cols} FROM coarse"
    scopes = f"{scopes} WHERE day = '{by_scope}'" if by_scope else f"{scopes} UNION ALL SELECT 'all' AS scope, event_id, {cols} FROM coarse"
    text_values = "\n    UNION ALL ".join(f"SELECT scope, event_id, {i} AS slot, {c} AS text, NULL::BIGINT AS num FROM scoped" for i, c in enumerate(TEXT_FEATURES))
    long_values = "\n    UNION ALL ".join(
        f"SELECT scope, event_id, {len(TEXT_FEATURES) + i} AS slot, NULL AS text, {c} AS num FROM scoped" for i, c in enumerate(LONG_FEATURES)
    )
    share = lambda a, n: f"(({a})::DOUBLE / ({n}))"
    gini = lambda a, n: f"((1.0 - {share(f'{n} - {a}', n)} * {share(f'{n} - {a}', n)}) - {share(a, n)} * {share(a, n)})"
    out = [
        f"scoped AS ({scopes})",
        "labels AS (SELECT scope, Tag, row_number() OVER (PARTITION BY scope ORDER BY n DESC, Tag) - 1 AS y FROM (SELECT scope, Tag, count(*) AS n FROM scoped GROUP BY scope, Tag))",
        f"sides AS MATERIALIZED (SELECT c.scope, c.event_id, c.Tag, l.y, {_split_expr('c.event_id')} AS part FROM scoped c JOIN labels l USING (scope, Tag))",
        f"vals AS (\n    {text_values}\n    UNION ALL {long_values})",
        "domain AS (SELECT scope, slot, text, num, count(*) AS n_all FROM vals GROUP BY scope, slot, text, num)",
        f"""kinds AS MATERIALIZED (SELECT scope, slot, text, num, (slot < {len(TEXT_FEATURES)} OR count(*) OVER (PARTITION BY scope, slot) <= 10) AS nominal,
    row_number() OVER (PARTITION BY scope, slot ORDER BY CASE WHEN text IS NULL THEN 0 ELSE -n_all END, text, num) AS idx FROM domain)""",
        """cells AS MATERIALIZED (SELECT v.scope, v.event_id, v.slot, k.idx, k.nominal, v.num FROM vals v JOIN kinds k
    ON k.scope = v.scope AND k.slot = v.slot AND k.text IS NOT DISTINCT FROM v.text AND k.num IS NOT DISTINCT FROM v.num)""",
        """nexts AS MATERIALIZED (SELECT scope, slot, num, lead(num) OVER (PARTITION BY scope, slot ORDER BY num) AS next_num
    FROM (SELECT DISTINCT c.scope, c.slot, c.num FROM cells c JOIN sides s USING (scope, event_id) WHERE s.part = 'train' AND NOT c.nominal))""",
        "at0 AS (SELECT scope, event_id, part, y, '' AS path FROM sides)",
    ]
    for k in range(TREE_DEPTH):
        out += [
            f"""open{k} AS (SELECT scope, path FROM at{k} WHERE part = 'train' AND length(path) = {k} GROUP BY scope, path HAVING min(y) < max(y))""",
            f"""counts{k} AS (SELECT a.scope, a.path, c.slot, c.idx, any_value(c.nominal) AS nominal, any_value(c.num) AS num, count(*) AS n, sum(a.y)::BIGINT AS n1
    FROM at{k} a JOIN open{k} o USING (scope, path) JOIN cells c USING (scope, event_id) WHERE a.part = 'train' GROUP BY a.scope, a.path, c.slot, c.idx)""",
            f"""placed{k} AS MATERIALIZED (SELECT c.*, row_number() OVER (PARTITION BY c.scope, c.path, c.slot
    ORDER BY CASE WHEN c.nominal THEN c.n1 ELSE c.num END, c.idx) AS pos FROM counts{k} c)""",
            f"""sums{k} AS (SELECT *, sum(n) OVER w AS nl, sum(n1) OVER w AS al, sum(n) OVER t AS nt, sum(n1) OVER t AS atot
    FROM placed{k} WINDOW w AS (PARTITION BY scope, path, slot ORDER BY pos ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY scope, path, slot))""",
            f"""gains{k} AS (SELECT *, ({gini('atot', 'nt')} - nl::DOUBLE / nt * {gini('al', 'nl')}) - (nt - nl)::DOUBLE / nt * {gini('(atot - al)', '(nt - nl)')} AS gain
    FROM sums{k} WHERE nl < nt)""",
            f"""best{k} AS MATERIALIZED (SELECT g.scope, g.path, g.slot, g.pos, g.nominal, g.num, g.gain, (g.num::DOUBLE + x.next_num::DOUBLE) / 2.0 AS threshold
    FROM (SELECT * FROM gains{k} QUALIFY row_number() OVER (PARTITION BY scope, path ORDER BY gain DESC, slot, pos) = 1) g
    LEFT JOIN nexts x ON x.scope = g.scope AND x.slot = g.slot AND x.num = g.num AND NOT g.nominal WHERE g.gain > 0)""",
            f"""at{k + 1} AS MATERIALIZED (SELECT a.scope, a.event_id, a.part, a.y, a.path || CASE WHEN b.slot IS NULL THEN ''
      WHEN CASE WHEN b.nominal THEN p.idx IS NOT NULL ELSE c.num <= b.threshold END THEN 'L' ELSE 'R' END AS path
    FROM at{k} a LEFT JOIN best{k} b USING (scope, path) LEFT JOIN cells c ON c.scope = a.scope AND c.event_id = a.event_id AND c.slot = b.slot
    LEFT JOIN placed{k} p ON b.nominal AND p.scope = a.scope AND p.path = a.path AND p.slot = b.slot AND p.idx = c.idx AND p.pos <= b.pos)""",
        ]
    bests = " UNION ALL ".join(f"SELECT * FROM best{k}" for k in range(TREE_DEPTH))
    paths = " UNION ALL ".join(f"SELECT scope, substr(path, 1, {k}) AS path, y FROM at{TREE_DEPTH} WHERE part = 'train' AND length(path) >= {k}" for k in range(TREE_DEPTH + 1))
    out += [
        f"splits AS ({bests})",
        f"""full_tree AS MATERIALIZED (SELECT p.scope, p.path, p.n0, p.n1, CASE WHEN p.n1 > p.n0 THEN 1 ELSE 0 END AS pred, s.slot, s.gain, s.threshold
    FROM (SELECT scope, path, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM ({paths}) GROUP BY scope, path) p LEFT JOIN splits s USING (scope, path))""",
        f"keep{TREE_DEPTH} AS (SELECT scope, path, pred, slot IS NOT NULL AS split FROM full_tree)",
    ]
    for k in reversed(range(TREE_DEPTH)):  # undo splits of level k
        out.append(
            f"""keep{k} AS (SELECT t.scope, t.path, t.pred, t.split AND NOT (length(t.path) = {k} AND NOT l.split AND NOT r.split AND l.pred = r.pred) AS split
    FROM keep{k + 1} t LEFT JOIN keep{k + 1} l ON l.scope = t.scope AND l.path = t.path || 'L' LEFT JOIN keep{k + 1} r ON r.scope = t.scope AND r.path = t.path || 'R')"""
        )
        out[-1] = out[-1].replace("t.split AND NOT (", "t.split AND NOT coalesce(", 1).replace("l.pred = r.pred) AS split", "l.pred = r.pred, false) AS split", 1)
    out += [
        f"""tree AS (SELECT f.*, k.split FROM full_tree f JOIN keep0 k USING (scope, path)
    WHERE NOT EXISTS (SELECT 1 FROM keep0 u WHERE u.scope = f.scope AND NOT u.split AND length(u.path) < length(f.path) AND starts_with(f.path, u.path)))""",
        f"""tree_predicted AS (SELECT a.scope, a.event_id, s.Tag, CAST(a.y AS DOUBLE) AS indexedLabel, CAST(t.pred AS DOUBLE) AS prediction
    FROM at{TREE_DEPTH} a JOIN sides s USING (scope, event_id) JOIN full_tree t ON t.scope = a.scope AND t.path = a.path WHERE a.part = 'test')""",
    ]
    return out


def oracle_sql() -> dict[str, str]:
    flows = FLOWS_CTE
    q: dict[str, str] = {}
    cols = ", ".join(FLOW_COLS)
    q["flow_rows"] = with_ctes(flows, body=f"SELECT event_id, day, {cols} FROM flows")
    q["fill_missing"] = with_ctes(flows, FILLED_CTE, body=f"SELECT event_id, day, {cols} FROM filled")
    q["address_prefix"] = with_ctes(
        flows,
        body=f"SELECT event_id, {_prefix('destination')} AS destination, {_prefix('source')} AS source FROM flows",
    )
    q["hour_text"] = with_ctes(
        flows,
        body="SELECT event_id, substring(startDateTime, 12, 2) AS startDateTime, "
        "substring(stopDateTime, 12, 2) AS stopDateTime FROM flows",
    )
    q["coarsen_flows"] = with_ctes(flows, COARSE_CTE, body=f"SELECT event_id, day, {cols} FROM coarse")
    q["flow_count"] = with_ctes(flows, body="SELECT day, count(*) AS flows FROM flows GROUP BY day")
    q["tag_counts"] = with_ctes(flows, body="SELECT day, Tag, count(Tag) AS count FROM flows GROUP BY day, Tag")
    q["tag_share"] = with_ctes(
        flows,
        body="SELECT day, Tag, count(Tag) AS count, "
        "CAST(count(Tag) AS DOUBLE) / nullif(sum(count(Tag)) OVER (PARTITION BY day), 0) AS share "
        "FROM flows GROUP BY day, Tag",
    )
    q["flow_stats"] = with_ctes(
        flows,
        body="SELECT day, Tag, count(Tag) AS count, CAST(sum(count(*)) OVER (PARTITION BY day) AS BIGINT) AS flows, "
        "CAST(count(Tag) AS DOUBLE) / nullif(sum(count(Tag)) OVER (PARTITION BY day), 0) AS share "
        "FROM flows GROUP BY day, Tag",
    )
    q["min_max"] = with_ctes(
        flows,
        body="SELECT event_id, day, totalDestinationBytes, "
        "CAST(totalDestinationBytes - min(totalDestinationBytes) OVER (PARTITION BY day) AS DOUBLE) / "
        "nullif(max(totalDestinationBytes) OVER (PARTITION BY day) - min(totalDestinationBytes) OVER (PARTITION BY day), 0) "
        "AS totalDestinationBytes_scaled FROM flows",
    )
    q["union_days"] = q["flow_rows"]
    q["xml_days"] = with_ctes(flows, body=f"SELECT event_id, day, {cols} FROM flows")
    q["label_index"] = with_ctes(
        flows,
        COARSE_CTE,
        _index_cte(),
        body="SELECT value AS Tag, idx AS indexedLabel, n FROM ranked WHERE feature = 'Tag'",
    )
    q["feature_index"] = with_ctes(
        flows,
        COARSE_CTE,
        _index_cte(),
        body="SELECT feature, value, idx, n FROM ranked WHERE feature <> 'Tag'",
    )
    q["label_index_by_day"] = with_ctes(
        flows,
        COARSE_CTE,
        _index_cte(scope_by_day=True),
        body="SELECT day, value AS Tag, idx AS indexedLabel, n FROM ranked WHERE feature = 'Tag'",
    )
    feature_names = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES))
    q["distinct_per_feature"] = with_ctes(
        flows,
        COARSE_CTE,
        _index_cte(),
        _slots_cte(),
        f"names(slot, feature) AS (VALUES {feature_names})",
        body="SELECT s.slot, n.feature, s.n_distinct, s.n_distinct <= 10 AS categorical "
        "FROM slot_stats s JOIN names n ON n.slot = s.slot",
    )
    q["vector_slots"] = with_ctes(
        flows,
        COARSE_CTE,
        _index_cte(),
        _slots_cte(),
        _recode_cte(),
        body="SELECT s.event_id, s.slot, s.value, r.indexed_value FROM slots s "
        "JOIN recode r ON r.slot = s.slot AND r.value = s.value",
    )
    q["split_by_key"] = with_ctes(flows, body=f"SELECT event_id, day, {_split_expr()} AS part FROM flows")
    rule = "CASE WHEN appName = 'SSH' THEN 'Attack' ELSE 'Normal' END"
    scored = (
        f"scored AS (SELECT day, Tag, {rule} AS predictedLabel FROM flows WHERE {_split_expr()} = 'test')"
    )
    q["accuracy"] = with_ctes(
        flows,
        scored,
        body="SELECT day, count(*) AS n, avg(CASE WHEN predictedLabel = Tag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, "
        "1 - avg(CASE WHEN predictedLabel = Tag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS test_error FROM scored GROUP BY day",
    )
    q["confusion"] = with_ctes(
        flows,
        scored,
        body="SELECT day, Tag, predictedLabel, count(*) AS n FROM scored GROUP BY day, Tag, predictedLabel",
    )
    day_rank = (
        "ranked_day AS (SELECT day, Tag, CAST(row_number() OVER (PARTITION BY day ORDER BY n DESC, Tag) - 1 AS DOUBLE) "
        "AS indexedLabel FROM (SELECT day, Tag, count(*) AS n FROM filled GROUP BY day, Tag))"
    )
    q["split_and_label_one_day"] = with_ctes(
        flows,
        FILLED_CTE,
        day_rank,
        body=f"SELECT f.event_id, f.day, f.Tag, r.indexedLabel FROM filled f JOIN ranked_day r "
        f"ON r.day = f.day AND r.Tag = f.Tag WHERE f.day = 'Jun14' AND {_split_expr()} = 'test'",
    )
    q["split_and_label_by_day"] = with_ctes(
        flows,
        FILLED_CTE,
        day_rank,
        body=f"SELECT f.event_id, f.day, f.Tag, r.indexedLabel FROM filled f JOIN ranked_day r "
        f"ON r.day = f.day AND r.Tag = f.Tag WHERE {_split_expr()} = 'test'",
    )
    q["split_count_by_day"] = with_ctes(
        flows, body=f"SELECT day, count(*) AS n FROM flows WHERE {_split_expr()} = 'test' GROUP BY day"
    )
    q["feature_index_by_day"] = with_ctes(
        flows,
        COARSE_CTE,
        _index_cte(scope_by_day=True),
        body="SELECT day, feature, value, idx, n FROM ranked WHERE feature <> 'Tag'",
    )
    q["distinct_per_feature_by_day"] = with_ctes(
        flows,
        COARSE_CTE,
        _index_cte(scope_by_day=True),
        _slots_cte(by_day=True),
        f"names(slot, feature) AS (VALUES {feature_names})",
        body="SELECT s.day, s.slot, n.feature, s.n_distinct, s.n_distinct <= 10 AS categorical "
        "FROM slot_stats s JOIN names n ON n.slot = s.slot",
    )
    joins = " ".join(
        f"JOIN ranked r{i} ON r{i}.feature = '{c}' AND r{i}.value = c.{c}" for i, c in enumerate(["Tag", *TEXT_FEATURES])
    )
    idx_cols = ", ".join(f"r{i + 1}.idx AS {c}_index" for i, c in enumerate(TEXT_FEATURES))
    vector = "CAST([" + ", ".join(
        [f"r{i + 1}.idx" for i in range(len(TEXT_FEATURES))] + [f"CAST(c.{c} AS DOUBLE)" for c in LONG_FEATURES]
    ) + "] AS VARCHAR)"
    q["csv_prepared"] = with_ctes(
        flows,
        COARSE_CTE,
        _index_cte(),
        body=f"SELECT c.event_id, c.day, r0.idx AS indexedLabel, {idx_cols}, {vector} AS features "
        f"FROM coarse c {joins}",
    )
    q["split_and_label_all_days"] = with_ctes(
        flows,
        FILLED_CTE,
        "ranked_all AS (SELECT Tag, CAST(row_number() OVER (ORDER BY n DESC, Tag) - 1 AS DOUBLE) AS indexedLabel "
        "FROM (SELECT Tag, count(*) AS n FROM filled GROUP BY Tag))",
        body=f"SELECT f.event_id, f.day, f.Tag, r.indexedLabel FROM filled f JOIN ranked_all r ON r.Tag = f.Tag "
        f"WHERE {_split_expr()} = 'test'",
    )
    q["split_count_all_days"] = with_ctes(
        flows, body=f"SELECT 'all' AS day, count(*) AS n FROM flows WHERE {_split_expr()} = 'test'"
    )
    stump = [flows, COARSE_CTE, *_stump_ctes(), f"names(slot, feature) AS (VALUES {feature_names})"]
    q["stump_nodes"] = with_ctes(
        *stump,
        body="SELECT t.scope AS day, t.node, CASE WHEN t.node = 0 THEN b.slot END AS slot, CASE WHEN t.node = 0 THEN n.feature END AS feature, "
        "CASE WHEN t.node = 0 THEN round(b.gain, 9) END AS gain, CASE WHEN t.n1 > t.n0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction, "
        "t.n0 AS n_first_label, t.n1 AS n_second_label FROM stump t JOIN best b USING (scope) JOIN names n ON n.slot = b.slot",
    )
    decoded = "JOIN labels l ON l.scope = p.scope AND l.y = p.prediction"
    q["stump_scored"] = with_ctes(
        *stump,
        body=f"SELECT p.event_id, p.scope AS day, p.Tag, p.indexedLabel, p.prediction, l.Tag AS predictedLabel FROM predicted p {decoded} WHERE p.scope <> 'all'",
    )
    q["stump_scored_all_days"] = with_ctes(
        *stump,
        body=f"SELECT p.event_id, f.day, p.Tag, p.indexedLabel, p.prediction, l.Tag AS predictedLabel FROM predicted p {decoded} "
        "JOIN flows f ON f.event_id = p.event_id WHERE p.scope = 'all'",
    )
    hit = "avg(CASE WHEN prediction = indexedLabel THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    q["stump_test_error"] = with_ctes(
        *stump, body=f"SELECT scope AS day, count(*) AS n, round({hit}, 9) AS accuracy, round(1 - {hit}, 9) AS test_error FROM predicted GROUP BY scope"
    )
    q["stump_importances"] = with_ctes(
        *stump,
        body="SELECT b.scope AS day, n.slot, n.feature, CASE WHEN n.slot = b.slot THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance, "
        "CAST(CASE WHEN n.slot = b.slot THEN 1 WHEN n.slot < b.slot THEN n.slot + 2 ELSE n.slot + 1 END AS INTEGER) AS rank FROM best b CROSS JOIN names n",
    )
    for name, scope in (("tree_nodes", None), ("tree_nodes_one_day", "Jun14")):
        q[name] = with_ctes(
            flows, COARSE_CTE, *_tree_ctes(scope), f"names(slot, feature) AS (VALUES {feature_names})",
            body="SELECT t.scope AS day, t.path, t.split AS is_split, CASE WHEN t.split THEN t.slot END AS slot, CASE WHEN t.split THEN n.feature END AS feature, "
            "CASE WHEN t.split THEN t.threshold END AS threshold, CASE WHEN t.split THEN round(t.gain, 9) END AS gain, CAST(t.pred AS DOUBLE) AS prediction, "
            "t.n0 AS n_first_label, t.n1 AS n_second_label FROM tree t LEFT JOIN names n ON n.slot = t.slot",
        )
    for name, scope, which in (("tree_scored", None, "p.scope <> 'all'"), ("tree_scored_all_days", None, "p.scope = 'all'"), ("tree_scored_one_day", "Jun14", "true")):
        q[name] = with_ctes(
            flows, COARSE_CTE, *_tree_ctes(scope),
            body="SELECT p.event_id, f.day, p.Tag, p.indexedLabel, p.prediction, l.Tag AS predictedLabel FROM tree_predicted p "
            f"JOIN labels l ON l.scope = p.scope AND l.y = p.prediction JOIN flows f ON f.event_id = p.event_id WHERE {which}",
        )
    q["tree_sample"] = with_ctes(
        flows, COARSE_CTE, *_tree_ctes("Jun14"),
        body="SELECT p.event_id, l.Tag AS predictedLabel, p.Tag, c.slot, "
        "CASE WHEN c.num IS NULL THEN CAST(c.idx - 1 AS DOUBLE) ELSE CAST(c.num AS DOUBLE) END AS value "
        "FROM (SELECT * FROM tree_predicted ORDER BY event_id LIMIT 5) p JOIN labels l ON l.scope = p.scope AND l.y = p.prediction JOIN cells c ON c.scope = p.scope AND c.event_id = p.event_id",
    )
    q["feature_index_table"] = q["feature_index"]
    codes = ", ".join(f"r{i}.idx AS {c}_index" for i, c in enumerate(["Tag", *TEXT_FEATURES]))
    q["feature_codes"] = with_ctes(flows, COARSE_CTE, _index_cte(), body=f"SELECT c.event_id, c.day, {codes} FROM coarse c {joins}")
    q["train_rows_kept"] = with_ctes(
        flows,
        body=f"SELECT count(*) AS n_rows, count(*) FILTER ({_split_expr()} = 'train') AS n_train, count(*) FILTER ({_split_expr()} = 'test') AS n_test FROM flows",
    )
    edge = (
        "edge AS (SELECT event_id, CASE WHEN day <> 'Jun13' THEN day END AS day, "
        "CASE WHEN day <> 'Jun12' THEN 1152921504606846976 + totalDestinationBytes * 1000003 END AS totalDestinationBytes FROM flows)"
    )
    span = "max(totalDestinationBytes) OVER (PARTITION BY day) - min(totalDestinationBytes) OVER (PARTITION BY day)"
    q["min_max_null_day"] = with_ctes(
        flows,
        edge,
        body="SELECT event_id, day, totalDestinationBytes, CAST(totalDestinationBytes - min(totalDestinationBytes) OVER (PARTITION BY day) AS DOUBLE) "
        f"/ nullif({span}, 0) AS totalDestinationBytes_scaled FROM edge",
    )
    q["csv_roundtrip"] = with_ctes(flows, COARSE_CTE, body=f"SELECT event_id, day, {cols} FROM coarse")
    return q
