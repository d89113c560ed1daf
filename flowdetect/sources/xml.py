"""XML flow files: one file per capture day, one row element per flow.

A day file is read as text cut before every ``<row`` tag, so Spark splits a
large file over tasks whatever its layout (indented, one record per line, all in
one line). A piece holds its record's own closing tag: a record that the file's
end cuts off is seen as such. Each record is parsed with ``from_xml`` and the
explicit schema; no inference pass runs over the data, and the date-times stay text.

Comments, processing instructions and CDATA sections may hold row tags, also
over many pieces and file splits. A first pass looks for pieces that end
inside one. Files without such a piece (the common case) are cut by built-in
expressions alone. For the others, every split gives the state (plain, comment,
CDATA, instruction) it ends in for each state it may begin in; these few small
functions, one a split, are composed along each file, and then each
split is cut from its known state. A record that goes on in the next split
is put together from its fragments. The XML is parsed once and kept as Parquet by
day (``sources.parquet``).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.schema import DAY_COL, DAY_FILES, FLOW_SCHEMA, day_label

ROOT_TAG = "dataroot"
CORRUPT_COL = "_corrupt_record"


def row_tag(file_name: str) -> str:
    return f"{file_name}Flows"


def day_file_path(base: str, file_name: str) -> str:
    return f"{base.rstrip('/')}/{file_name}.xml"


def flow_schema(extra_fields: Sequence[T.StructField] = ()) -> T.StructType:
    return T.StructType(list(extra_fields) + list(FLOW_SCHEMA.fields))


# ------------------------------------------------- states within a file

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the scan of a split travels with its job

PLAIN = 0
#: What opens and closes a comment, a CDATA section, a processing instruction (states 1 to 3).
OPENERS = ("<!--", "<![CDATA[", "<?")
CLOSERS = ("-->", "]]>", "?>")
CDATA = 2

_OPENER = re.compile("|".join(re.escape(o) for o in OPENERS))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def scan_piece(text: str, state: int) -> tuple[str, int]:
    """(plain XML, state at the end) of a piece that begins in ``state``.

    Comments and instructions go, CDATA becomes escaped text, so every tag of the
    result is a tag.
    """
    out, at = [], 0
    while True:
        if state == PLAIN:
            found = _OPENER.search(text, at)
            if not found:
                out.append(text[at:])
                break
            out.append(text[at : found.start()])
            at, state = found.end(), 1 + OPENERS.index(found.group())
        end = text.find(CLOSERS[state - 1], at)
        if state == CDATA:
            out.append(_escaped(text[at : end if end >= 0 else len(text)]))
        if end < 0:
            break
        at, state = end + len(CLOSERS[state - 1]), PLAIN
    return "".join(out), state


_NAME_GOES_ON = r"^[^\s/><\uFEFF]"  # a longer element name that begins with the row's


def _plain_text(piece):
    """Column: ``scan_piece`` from the plain state, for pieces that end in it."""
    parts = F.regexp_extract_all(piece, F.lit(r"(?s)(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|[^<]+|<)"), F.lit(1))
    escaped = lambda p: F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shown = lambda p: (
        F.when(p.startswith(OPENERS[1]), escaped(F.substring(p, F.lit(len(OPENERS[1]) + 1), F.length(p) - len(OPENERS[1]) - len(CLOSERS[1]))))
        .when(p.startswith(OPENERS[0]) | p.startswith(OPENERS[2]), F.lit(""))
        .otherwise(p)
    )
    return F.when(_has_opener(piece), F.array_join(F.transform(parts, shown), "")).otherwise(piece)


def _has_opener(piece):
    return piece.contains("<!") | piece.contains("<?")


def _needs_order(piece):
    """Column: a piece that does not return to plain text, or continues the name of the row's tag."""
    closed = F.regexp_replace(piece, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "")
    left_open = F.when(_has_opener(piece), closed.rlike(r"<!--|<!\[CDATA\[|<\?")).otherwise(F.lit(False))
    return left_open | piece.rlike(_NAME_GOES_ON)


def _pieces(spark: SparkSession, path: str, tag: str, label: str) -> DataFrame:
    """(value, file, split, tag, label): the text between ``<tag`` and the next; rows of a split come in file order."""
    text = spark.read.option("lineSep", f"<{tag}").text(path)
    return text.selectExpr("value", "_metadata.file_path as file", "_metadata.file_block_start as split", f"'{tag}' as tag", f"'{label}' as label")


def _files_to_order(pieces: DataFrame) -> dict[tuple[str, str], list[str]]:
    """Files with a piece that needs the state before it, by (tag, label): one job over all inputs."""
    out: dict[tuple[str, str], list[str]] = {}
    for row in pieces.where(_needs_order(F.col("value"))).select("tag", "label", "file").distinct().collect():  # one row a file
        out.setdefault((row["tag"], row["label"]), []).append(row["file"])
    return out


def _by_split(batches):
    """(file, split, pieces) runs of a task's rows."""
    for batch in batches:
        value, file, split = (batch.column(k).to_pylist() for k in range(3))
        lo = 0
        for hi in range(1, len(value) + 1):
            if hi == len(value) or (file[hi], split[hi]) != (file[lo], split[lo]):
                yield file[lo], split[lo], value[lo:hi]
                lo = hi


def _split_functions(pieces: DataFrame) -> dict[tuple[str, int], int]:
    """The state in which each split begins, composed from the splits' functions along each file."""

    def run(batches):
        here, ends = None, None
        rows = []
        for file, split, values in _by_split(batches):
            if (file, split) != here:
                if here:
                    rows.append((*here, ends))
                here, ends = (file, split), list(range(len(OPENERS) + 1))
            for value in values:
                now = {state: scan_piece(value, state)[1] for state in set(ends)}
                ends = [now[state] for state in ends]
        if here:
            rows.append((*here, ends))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
            ["file", "split", "ends"],
        )

    found = pieces.mapInArrow(run, "file string, split long, ends array<int>").collect()  # one short row a file split
    out, state, file = {}, PLAIN, None
    for row in sorted(found, key=lambda r: (r["file"], r["split"])):
        if row["file"] != file:
            file, state = row["file"], PLAIN
        out[row["file"], row["split"]] = state
        state = row["ends"][state]
    return out


def _ordered_pieces(pieces: DataFrame, tag: str) -> DataFrame:
    """(value): the pieces of some files in plain XML, each from one row tag to the next.

    A task glues what belongs together inside a split. The last piece of a split
    may go on in the next one: it and the next ones' beginnings leave as
    fragments, two a split at most, and meet by their place in the file.
    """
    begins = _split_functions(pieces)
    unknown = "the splits of a file changed between two passes"

    def fragments(batches):
        here, state, text, head = None, PLAIN, [], True
        out: list[tuple] = []

        def close(last: bool):
            # a split's first text goes on from the one before; its last one may go on
            if here and (text or last):
                kind = ("whole" if head and last else "head" if head else "tail" if last else "done")
                out.append((kind, *here, "".join(text)))

        for file, split, values in _by_split(batches):
            if (file, split) != here:
                close(True)
                if (file, split) not in begins:
                    raise ValueError(unknown)
                here, state, text, head = (file, split), begins[file, split], [], True
                first = split == 0
            for value in values:
                if first and state == PLAIN:  # text before the first row tag of a file
                    plain, state = scan_piece(value, state)
                    text.append(plain)
                else:
                    separator = f"<{tag}"
                    if state == PLAIN and not re.match(_NAME_GOES_ON, value):
                        close(False)
                        text, head = [separator], False
                    elif state == PLAIN:
                        text.append(separator)
                    elif state == CDATA:
                        text.append(_escaped(separator))
                    plain, state = scan_piece(value, state)
                    text.append(plain)
                first = False
            if len(out) >= 1000:
                yield batch_of(out)
                out.clear()
        close(True)
        yield batch_of(out)

    def batch_of(rows):
        columns = [pa.array([r[k] for r in rows], pa.int64() if k == 2 else pa.string()) for k in range(4)]
        return pa.RecordBatch.from_arrays(columns, ["kind", "file", "split", "value"])

    return pieces.mapInArrow(fragments, "kind string, file string, split long, value string")


def _glued(found: DataFrame) -> DataFrame:
    """Fragments of one piece put together: a tail, the whole splits after it, and the next head."""
    open_ = found.where("kind <> 'done'")
    turn = F.when(F.col("kind") == "head", 0).when(F.col("kind") == "whole", 1).otherwise(2)
    order = Window.partitionBy("file").orderBy("split", turn)  # two short rows a split
    numbered = open_.select("file", "split", turn.alias("turn"), "value", F.sum((F.col("kind") == "tail").cast("long")).over(order).alias("group"))
    texts = numbered.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("split", "turn", "value"))).alias("parts"))
    return found.where("kind = 'done'").select("value").union(texts.select(F.array_join("parts.value", "").alias("value")))


# ------------------------------------------------------------ records


def _record(piece, tag):
    """Column: (text, complete) of the row element at the start of a piece of plain XML, null when there is none."""
    opened = piece.rlike(r"^(?:\s[^<]*)?/?>|^\s+[\w:]|^\s*/$")  # whole, or cut off inside the tag
    begin, closing = F.concat(F.lit("<"), tag), F.concat(F.lit("</"), tag, F.lit(">"))
    at = F.position(closing, piece)
    spaced = F.call_function("regexp_extract", piece, F.concat(F.lit(r"(?s)^(.*?)</\Q"), tag, F.lit(r"\E\s+>")), F.lit(1))
    empty = F.regexp_extract(piece, r"""^((?:\s+[\w.:\-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*/>)""", 1)
    shown = lambda complete, *text: F.struct(F.concat(begin, *text).alias("text"), F.lit(complete).alias("complete"))
    whole = (
        F.when(empty != "", shown(True, empty))
        .when(at > 0, shown(True, F.substring(piece, F.lit(1), at - 1), closing))
        .when(spaced != "", shown(True, spaced, closing))
        .otherwise(shown(False, piece))
    )
    return F.when(opened, whole)


def _cut_records(pieces: DataFrame) -> DataFrame:
    """(label, text, complete) of every row element of the inputs."""
    to_order = _files_to_order(pieces)
    direct = pieces
    if to_order:
        direct = pieces.where(~F.concat("tag", "label", "file").isin([t + d + f for (t, d), files in to_order.items() for f in files]))
    plain = direct.select("tag", "label", _plain_text(F.col("value")).alias("piece"))
    for (tag, label), files in to_order.items():
        mine = pieces.where((F.col("tag") == tag) & (F.col("label") == label) & F.col("file").isin(files))
        own = F.when(F.col("value").startswith(f"<{tag}"), F.substring(F.col("value"), F.lit(len(tag) + 2), F.length("value")))
        plain = plain.union(_glued(_ordered_pieces(mine, tag)).select(F.lit(tag), F.lit(label), own))
    records = plain.select("label", _record(F.col("piece"), F.col("tag")).alias("record")).where("record is not null")
    return records.select("label", "record.*")


def read_flow_day(
    spark: SparkSession,
    path: str,
    file_name: str,
    *,
    schema: T.StructType | None = None,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """Read one day file (S1). Missing elements read as null, empty text as ``""``.

    Every row element is a row, an element without fields too (all null).
    ``mode``: PERMISSIVE turns a bad number into null (keeping the raw record in
    ``_corrupt_record`` when the schema has that column), FAILFAST raises,
    DROPMALFORMED drops the record. A record that the file's end cuts off is
    malformed: a row of nulls with the raw text, an error, or dropped.
    """
    return _read(spark, [(path, file_name)], schema or FLOW_SCHEMA, mode).drop(DAY_COL)


def _read(spark: SparkSession, inputs: Sequence[tuple[str, str]], schema: T.StructType, mode: str) -> DataFrame:
    """The rows of some (path, file name) with their day: one scan each, one chain of expressions for all."""
    pieces = [_pieces(spark, path, row_tag(name), day_label(name)) for path, name in inputs]
    records = _cut_records(reduce(DataFrame.union, pieces))
    parsed = T.StructType([f for f in schema.fields if f.name != CORRUPT_COL]).add(CORRUPT_COL, T.StringType())  # the parser wants it last
    options = {"mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    text, complete = F.col("text"), F.col("complete")
    rows = records.select("label", "text", "complete", F.from_xml(F.when(complete, text), _ddl(parsed), options).alias("r"))
    refused = F.raise_error(F.concat(F.lit("a record is cut off: "), F.substring(text, 1, 200)))
    bad = F.when(~complete, refused if mode == "FAILFAST" else text).otherwise(F.col(f"r.{CORRUPT_COL}"))
    fields = [F.col(f"r.`{f.name}`") for f in parsed.fields if f.name != CORRUPT_COL]
    rows = rows.select(F.col("label").alias(DAY_COL), *fields, bad.alias(CORRUPT_COL))
    if mode != "PERMISSIVE":  # an error, or nothing
        rows = rows.where(F.col(CORRUPT_COL).isNull())
    return rows.select(*schema.fieldNames(), DAY_COL)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_flow_days(
    spark: SparkSession,
    base: str,
    file_names: Iterable[str] = DAY_FILES,
    *,
    extra_fields: Sequence[T.StructField] = (),
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """All day files as one table with a ``day`` column (S2, S3), bag union.

    Each file has its own row element, so each is one scan; the union keeps
    duplicates and adds no shuffle.
    """
    return _read(spark, [(day_file_path(base, n), n) for n in file_names], flow_schema(extra_fields), mode)


def write_flow_days(
    flows: DataFrame,
    base: str,
    file_names: Iterable[str] = DAY_FILES,
    *,
    columns: Sequence[str] | None = None,
    mode: str = "errorifexists",
    parallelism: int = 6,
) -> list[str]:
    """Write a flow table with a ``day`` column as one XML file set per day.

    The layout the reader expects: ``<base>/<name>.xml`` holding ``<name>Flows``
    rows under a ``dataroot`` element. Null columns are left out of a row, as
    a missing element. Days without rows are written empty.

    Rows of any other day, or without one, are an error.

    Each day needs its own row element, so each day is its own write; the
    writes (each into its own folder) run side by side. A table partitioned by day
    is read once in all, since each write prunes to its day.
    """
    cols = list(columns) if columns else [c for c in flows.columns if c != DAY_COL]
    names = list(file_names)
    rows = flows.select(DAY_COL, *cols)
    other = rows.where(F.col(DAY_COL).isNull() | ~F.col(DAY_COL).isin([day_label(n) for n in names])).limit(1).collect()
    if other:
        raise ValueError(f"flows of day {other[0][DAY_COL]!r} have no file among {names}")

    def one(name: str) -> str:
        path = day_file_path(base, name)
        (
            rows.where(F.col(DAY_COL) == day_label(name))
            .select(*cols)
            .write.format("xml")
            .option("rootTag", ROOT_TAG)
            .option("rowTag", row_tag(name))
            .mode(mode)
            .save(path)
        )
        return path

    workers = max(1, min(parallelism, len(names)))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(inheritable_thread_target(flows.sparkSession)(one), names))
