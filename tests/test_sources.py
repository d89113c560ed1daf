import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.operators.coarsen import prepare_flows
from flowdetect.schema import DAYS, FLOW_COLS
from flowdetect.session import local_path
from flowdetect.sources.csv import csv_schema_of, read_prepared_csv, write_prepared_csv
from flowdetect.sources.parquet import read_flows, write_flows_by_day
from flowdetect.sources.xml import CORRUPT_COL, flow_schema, read_flow_day, read_flow_days, scan_piece, write_flow_days

from tests.fixtures import flows

SAMPLE = """<dataroot>
<TestbedSatJun12Flows><appName>SSH</appName><totalSourceBytes>4180</totalSourceBytes>
<totalDestinationBytes>1932</totalDestinationBytes><totalDestinationPackets>3</totalDestinationPackets>
<totalSourcePackets>4</totalSourcePackets><direction>L2R</direction>
<destinationTCPFlagsDescription>F,P,A</destinationTCPFlagsDescription><source>192.0.1.7</source>
<protocolName>tcp_ip</protocolName><sourcePort>1024</sourcePort><destination>10.0.0.1</destination>
<destinationPort>22</destinationPort><startDateTime>2010-06-12T07:01:02</startDateTime>
<stopDateTime>2010-06-12T07:01:09</stopDateTime><Tag>Attack</Tag></TestbedSatJun12Flows>
<TestbedSatJun12Flows><appName></appName><Tag/><sourcePort>abc</sourcePort><destinationPort></destinationPort>
</TestbedSatJun12Flows>
</dataroot>
"""


def _write_sample(base):
    path = local_path(base)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "TestbedSatJun12.xml"), "w") as fh:
        fh.write(SAMPLE)
    return base


def test_xml_read_missing_and_empty(spark, scratch):
    base = _write_sample(scratch("xml-sample"))
    rows = read_flow_days(spark, base, ["TestbedSatJun12"]).orderBy(F.col("Tag").desc()).collect()
    first, second = rows
    assert first["day"] == "Jun12"
    assert first["Tag"] == "Attack"
    assert first["sourceTCPFlagsDescription"] is None  # missing element
    assert first["startDateTime"] == "2010-06-12T07:01:02"  # text, not a timestamp
    assert second["appName"] == "" and second["Tag"] == ""  # empty elements are empty text
    assert second["destinationPort"] is None  # empty number
    assert second["sourcePort"] is None  # bad number, permissive
    # after the pipeline's fill, the missing element is N/A and the empty text stays
    coarse = prepare_flows(read_flow_days(spark, base, ["TestbedSatJun12"])).orderBy(F.col("Tag").desc()).collect()
    assert coarse[0]["sourceTCPFlagsDescription"] == "N/A"
    assert coarse[1]["appName"] == ""


def test_xml_corrupt_record_and_failfast(spark, scratch):
    base = _write_sample(scratch("xml-bad"))
    path = f"{base}/TestbedSatJun12.xml"
    schema = flow_schema([T.StructField(CORRUPT_COL, T.StringType())])
    rows = read_flow_day(spark, path, "TestbedSatJun12", schema=schema).collect()
    bad = [r for r in rows if r["sourcePort"] is None and r["Tag"] == ""]
    assert bad and bad[0][CORRUPT_COL] and "abc" in bad[0][CORRUPT_COL]
    with pytest.raises(Exception):
        read_flow_day(spark, path, "TestbedSatJun12", mode="FAILFAST").collect()


def test_xml_roundtrip_all_days(spark, scratch):
    rows = [{"day": d, "Tag": "Attack" if i % 2 else "Normal", "event_id": i} for i, d in enumerate(DAYS)]
    rows.append({"day": "Jun12", "event_id": 99, "sourceTCPFlagsDescription": None})
    df = flows(spark, rows)
    base = scratch("xml-rt")
    write_flow_days(df, base, columns=["event_id", *FLOW_COLS])
    back = read_flow_days(spark, base, extra_fields=[T.StructField("event_id", T.LongType())])
    assert sorted(map(tuple, back.select("event_id", "day", *FLOW_COLS).collect())) == sorted(
        map(tuple, df.select("event_id", "day", *FLOW_COLS).collect())
    )


def test_parquet_by_day_prunes(spark, scratch):
    df = flows(spark, [{"day": d, "event_id": i} for i, d in enumerate(DAYS)])
    path = write_flows_by_day(df, scratch("by-day"))
    one = read_flows(spark, path).where(F.col("day") == "Jun14")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "Jun14" in plan
    assert [r["event_id"] for r in one.collect()] == [2]


def test_csv_sink_vectors_as_text_and_empty_string(spark, scratch):
    from pyspark.ml.linalg import Vectors, VectorUDT

    df = spark.createDataFrame(
        [(1, "", Vectors.dense([1.0, 0.0, 80.0]), "Jun12")],
        T.StructType(
            [
                T.StructField("event_id", T.LongType()),
                T.StructField("startDateTime", T.StringType()),
                T.StructField("features", VectorUDT()),
                T.StructField("day", T.StringType()),
            ]
        ),
    )
    path = write_prepared_csv(df, scratch("csv"))
    back = read_prepared_csv(spark, path, csv_schema_of(df)).collect()[0]
    assert back["features"] == "[1.0, 0.0, 80.0]"
    assert back["startDateTime"] is None  # empty text reads back as null by default
    assert back["day"] == "Jun12"
    assert os.path.isdir(os.path.join(local_path(path), "day=Jun12"))


def test_ingest_days(spark, scratch):
    from flowdetect.plans.programs import ingest_days
    from flowdetect.session import apply_cluster_conf

    rows = [{"day": d, "event_id": i} for i, d in enumerate(DAYS)]
    xml_base = scratch("ingest-xml")
    write_flow_days(flows(spark, rows), xml_base)
    table = ingest_days(spark, xml_base, scratch("ingest-parquet"))
    assert sorted(r["day"] for r in table.collect()) == sorted(DAYS)
    assert set(FLOW_COLS) <= set(table.columns)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    apply_cluster_conf(spark, {"spark.sql.shuffle.partitions": before})
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def _day_file(spark, scratch, name, text):
    base = scratch("xml-file")
    path = local_path(base)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"{name}.xml"), "w") as fh:
        fh.write(text)
    return base


@pytest.mark.parametrize("gap", ["\n  ", "", "\n"])
def test_xml_of_any_layout_splits_and_reads_all(spark, scratch, gap):
    n = 20_000
    tag = "TestbedSunJun13Flows"
    body = "".join(
        f"{gap}<{tag}>{gap}<appName>A{i % 7} &amp; b</appName>{gap}<Tag>Normal</Tag>{gap}<sourcePort>{i}</sourcePort></{tag}>" for i in range(n)
    )
    base = _day_file(spark, scratch, "TestbedSunJun13", f"<?xml version='1.0'?>\n<dataroot>{body}\n</dataroot>\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        rows = read_flow_days(spark, base, ["TestbedSunJun13"])
        assert rows.rdd.getNumPartitions() > 1
        got = rows.agg(F.count("*"), F.countDistinct("sourcePort"), F.min("appName"), F.max("day")).first()
        assert tuple(got) == (n, n, "A0 & b", "Jun13")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_xml_odd_elements(spark, scratch):
    tag = "TestbedSunJun13Flows"
    text = (
        f"<dataroot a='1'><{tag} id='7'><Tag>A</Tag></{tag}><{tag}/><{tag} x='1' /><!-- a note --><{tag}></{tag}>"
        f"<{tag}><Tag><![CDATA[x < y]]></Tag><sourcePort>oops</sourcePort></{tag}><{tag}s>no</{tag}s>\n</dataroot>"
    )
    base = _day_file(spark, scratch, "TestbedSunJun13", text)
    rows = read_flow_days(spark, base, ["TestbedSunJun13"]).collect()
    assert sorted(str(r["Tag"]) for r in rows) == ["A", "None", "None", "None", "x < y"]
    kept = read_flow_days(spark, base, ["TestbedSunJun13"], mode="DROPMALFORMED")
    assert kept.count() == 4
    with pytest.raises(Exception):
        read_flow_days(spark, base, ["TestbedSunJun13"], mode="FAILFAST").collect()


CORRUPT = flow_schema([T.StructField(CORRUPT_COL, T.StringType())])


def _read_split(spark, path, size, **options):
    """A day file read in splits of ``size`` bytes (None: one split)."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(size or 1 << 30))
    try:
        df = read_flow_day(spark, f"{path}/TestbedSunJun13.xml", "TestbedSunJun13", **options)
        cols = [c for c in ("appName", "Tag", "sourcePort", CORRUPT_COL) if c in df.columns]
        return df.rdd.getNumPartitions(), sorted(map(str, map(tuple, df.select(*cols).collect())))
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


def _legal_file(rng, n):
    """A legal file with row tags in comments, CDATA and instructions, and the (appName, Tag, sourcePort) it holds."""
    tag = "TestbedSunJun13Flows"
    other = f"<{tag}><appName>hidden</appName><Tag>no</Tag></{tag}>"
    long = "".join(f"<{tag}><appName>h{k}</appName></{tag}>\n" for k in range(40))
    junk = ["", "\n", f"<!-- {other} -->", f"<!--> {other} - ] ]]> ?> <![CDATA[ -->", f"<?old {other} --> ]]> ?>", f"<!--{long}-->", f"<{tag}s>{other[5:20]}</{tag}s>".replace("<appName", ""), "<!---->"]
    texts = [
        ("plain", "plain"), ("a &lt; b", "a < b"), (f"<![CDATA[x </{tag}> {other} y]]>", f"x </{tag}> {other} y"), ("<![CDATA[<!-- & ]]>", "<!-- & "),
        ("p<!-- <![CDATA[ -->q", "pq"), ("<![CDATA[]] > <?]]>r", "]] > <?r"), (f"<![CDATA[{long}]]>", long), (f"u<!-- </{tag}> -->v<?w <{tag}> ?>", "uv"),
    ]
    ends = [f"</{tag}>", f"</{tag} >", f"</{tag}\n>"]
    body, rows = [], []
    for k in range(n):
        text, value = rng.choice(texts)
        if rng.random() < 0.05:
            body.append(f"<{tag}/>")
            rows.append((None, None, None))
        else:
            at = rng.choice(["", " id='7'", ' a=">" b="x/>"'])
            body.append(f"<{tag}{at}>{rng.choice(junk[:5])}<appName>{text}</appName>\n<Tag>T{k % 3}</Tag><sourcePort>{k}</sourcePort>{rng.choice(ends)}")
            rows.append((value.strip(), f"T{k % 3}", k))  # the parser trims
        body.append(rng.choice(junk))
    return f"<?xml version='1.0'?>\n<!-- {other} -->\n<dataroot>" + "".join(body) + "\n</dataroot>\n", rows


@pytest.mark.parametrize("seed", range(2))
def test_xml_tags_inside_comments_and_cdata(spark, scratch, seed):
    text, rows = _legal_file(random.Random(seed), 150)
    base = _day_file(spark, scratch, "TestbedSunJun13", text)
    expected = sorted(map(str, rows))
    for size in (None, 1500, 311):
        parts, got = _read_split(spark, base, size)
        assert got == expected, size
        assert size is None or parts > 3
    assert _read_split(spark, base, 1500, mode="FAILFAST")[1] == expected


def test_xml_one_comment_over_many_splits(spark, scratch):
    tag = "TestbedSunJun13Flows"
    rows = [f"<{tag}><appName>A{k}</appName><Tag>T</Tag><sourcePort>{k}</sourcePort></{tag}>" for k in range(300)]
    hidden = "".join(rows[50:250])
    for opens, closes in (("<!--", "-->"), ("<?skip ", "?>")):
        base = _day_file(spark, scratch, "TestbedSunJun13", f"<dataroot>{''.join(rows[:50])}{opens}{hidden}{closes}{''.join(rows[250:])}</dataroot>")
        expected = sorted(str((f"A{k}", "T", k)) for k in [*range(50), *range(250, 300)])
        assert _read_split(spark, base, None)[1] == _read_split(spark, base, 700)[1] == expected
    # one text over many splits, and a file whose comment never ends
    base = _day_file(spark, scratch, "TestbedSunJun13", f"<dataroot><{tag}><appName><![CDATA[{hidden}]]></appName></{tag}>{rows[0]}</dataroot>")
    assert _read_split(spark, base, 700)[1] == sorted([str((hidden, None, None)), str(("A0", "T", 0))])
    base = _day_file(spark, scratch, "TestbedSunJun13", f"<dataroot>{rows[0]}<!--{hidden}")
    assert _read_split(spark, base, 700)[1] == [str(("A0", "T", 0))]


@pytest.mark.parametrize("end", ["<{t}><appName>CUT</appName>", "<{t}><appName>CU", "<{t}><Tag/>", "<{t}>", "<{t} id='7", "<{t} id='7'/", "<{t}><appName><![CDATA[CUT</{t}>"])
def test_xml_record_cut_off_by_the_files_end(spark, scratch, end):
    tag = "TestbedSunJun13Flows"
    base = _day_file(spark, scratch, "TestbedSunJun13", f"<dataroot><{tag}><appName>A</appName></{tag}>\n{end.format(t=tag)}")
    path = f"{base}/TestbedSunJun13.xml"
    rows = {r["appName"]: r[CORRUPT_COL] for r in read_flow_day(spark, path, "TestbedSunJun13", schema=CORRUPT).collect()}
    assert set(rows) == {"A", None} and rows["A"] is None and rows[None].startswith(f"<{tag}")
    assert [r["appName"] for r in read_flow_day(spark, path, "TestbedSunJun13", mode="DROPMALFORMED").collect()] == ["A"]
    with pytest.raises(Exception, match="cut off"):
        read_flow_day(spark, path, "TestbedSunJun13", mode="FAILFAST").collect()


def test_states_of_a_piece():
    assert scan_piece("a<!--b", 0) == ("a", 1) and scan_piece("b--> c", 1) == (" c", 0)
    assert scan_piece("x<y]]>z", 2) == ("x&lt;yz", 0) and scan_piece("<!-->", 0) == ("", 1)
    assert scan_piece("a<?b?>c<![CDATA[&", 0) == ("ac&amp;", 2) and scan_piece("-->", 3) == ("", 3)


def test_xml_write_refuses_other_days(spark, scratch):
    df = flows(spark, [{"day": "Jun12", "event_id": 1}, {"day": "Jul01", "event_id": 2}])
    with pytest.raises(ValueError, match="Jul01"):
        write_flow_days(df, scratch("xml-other"), columns=["event_id", *FLOW_COLS])


def test_xml_days_without_rows(spark, scratch):
    df = flows(spark, [{"day": "Jun12", "event_id": 1}, {"day": "Jun12", "event_id": 2}])
    base = scratch("xml-empty-days")
    write_flow_days(df, base, columns=["event_id", *FLOW_COLS])
    back = read_flow_days(spark, base, extra_fields=[T.StructField("event_id", T.LongType())])
    assert sorted((r["day"], r["event_id"]) for r in back.collect()) == [("Jun12", 1), ("Jun12", 2)]


def test_csv_null_marker_keeps_empty_text(spark, scratch):
    df = spark.createDataFrame([(1, "", None, "Jun12"), (2, "07", "x", "Jun12")], "event_id long, startDateTime string, appName string, day string")
    path = write_prepared_csv(df, scratch("csv-null"), null_value="\\N")
    back = {r["event_id"]: r for r in read_prepared_csv(spark, path, csv_schema_of(df), null_value="\\N").collect()}
    assert back[1]["startDateTime"] == "" and back[1]["appName"] is None
    assert back[2]["startDateTime"] == "07" and back[2]["appName"] == "x"


def test_days_are_written_as_their_rows_come(spark, scratch):
    """A task that sorts its rows by day first holds them all before it opens a file."""
    path = scratch("csv-as-rows-come")
    folder, parts, n = local_path(path), 12, 10_000

    def rows(batches):
        import time

        import pyarrow as pa

        list(batches)
        begun = lambda: any(name.startswith("day=") for _, folders, _ in os.walk(folder) for name in folders)
        for part in range(parts):
            end = time.time() + 15
            while part == parts - 1 and not begun() and time.time() < end:
                time.sleep(0.1)
            ids = range(part * n, (part + 1) * n)
            days = [f"Jun{12 + i % 6}" if i % 7 else None for i in ids]
            yield pa.RecordBatch.from_pydict({"event_id": list(ids), "begun": [begun()] * n, "text": [f"text of row {i}" for i in ids], "day": days})

    df = spark.range(1).coalesce(1).mapInArrow(rows, "event_id long, begun boolean, text string, day string")
    own = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    back = read_prepared_csv(spark, write_prepared_csv(df, path), csv_schema_of(df))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == own
    counts = {(r["day"], r["begun"]): r["count"] for r in back.groupBy("day", "begun").count().collect()}
    assert sum(counts.values()) == parts * n and len({day for day, _ in counts}) == 7
    assert sum(rows_of for (_, begun), rows_of in counts.items() if begun) >= n


def test_more_days_than_open_files(spark, scratch):
    from flowdetect.session import OPEN_FILES

    df = spark.range(1_000).selectExpr("id AS event_id", f"concat('day', id % {3 * OPEN_FILES}) AS day").coalesce(1)
    by_csv = read_prepared_csv(spark, write_prepared_csv(df, scratch("csv-many")), csv_schema_of(df))
    by_parquet = read_flows(spark, write_flows_by_day(df, scratch("parquet-many")))
    expected = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, by_csv.select("event_id", "day").collect())) == expected
    assert sorted(map(tuple, by_parquet.select("event_id", "day").collect())) == expected
