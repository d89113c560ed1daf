"""The command-line programs, run in-process on XML day files."""

from flowdetect.__main__ import main
from flowdetect.operators.coarsen import select_flows
from flowdetect.schema import FLOW_COLS
from flowdetect.sources.events import read_event_flows
from flowdetect.sources.xml import write_flow_days


def test_cli_programs(spark, scratch, capsys):
    xml = scratch("cli-xml")
    write_flow_days(select_flows(read_event_flows(spark, "/root/testdata/sf0.001")), xml, columns=FLOW_COLS)

    out = main(["stats", xml], spark)
    assert out["stats"].count() == 12

    table = scratch("cli-parquet")
    main(["ingest", xml, "--out", table], spark)
    out = main(["day", table, "--parquet", "--day", "Jun12", "--trees", "2", "--max-bins", "10000"], spark)
    assert out["run"].max_bins == 10000
    out["run"].release()

    out = main(["each-day", table, "--parquet", "--trees", "2", "--out", scratch("cli-each")], spark)
    assert out["result"].test_error().count() == 6
    out = main(
        ["each-day", table, "--parquet", "--trees", "2", "--days", "Jun12,Jun15", "--parallelism", "1"], spark
    )
    assert sorted(r["day"] for r in out["result"].test_error().collect()) == ["Jun12", "Jun15"]

    printed = capsys.readouterr().out
    assert "Test error per day:" in printed and "Flows per day and tag:" in printed
