from flowdetect.operators.coarsen import select_flows
from flowdetect.operators.stats import tag_counts
from flowdetect.plans import programs
from flowdetect.sources.events import read_event_flows
from flowdetect.sources.parquet import write_flows_by_day
from flowdetect.streaming import read_flow_stream, score_stream, stream_tag_counts

SF001 = "/root/testdata/sf0.001"


def test_stream_counts_and_scores(spark, scratch):
    flows = select_flows(read_event_flows(spark, SF001))
    path = write_flows_by_day(flows, scratch("stream-in"))
    schema = spark.read.parquet(path).schema
    stream = read_flow_stream(spark, path, schema, max_files_per_trigger=2)

    q = stream_tag_counts(stream).writeStream.outputMode("complete").format("memory").queryName("tagc").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT day, Tag, count FROM tagc").collect()))
    assert got == sorted(map(tuple, tag_counts(flows).collect()))

    from flowdetect.operators.stats import flow_count

    q1 = flow_count(stream).writeStream.outputMode("complete").format("memory").queryName("flowc").start()
    q1.processAllAvailable()
    q1.stop()
    got = sorted(map(tuple, spark.sql("SELECT day, flows FROM flowc").collect()))
    assert got == sorted(map(tuple, flow_count(flows).collect()))

    run = programs.train_day(flows, "Jun12", num_trees=2)
    try:
        s = score_stream(read_flow_stream(spark, path, schema), run.preparation, run.model)
        q2 = s.writeStream.format("memory").queryName("scoredstream").outputMode("append").start()
        q2.processAllAvailable()
        q2.stop()
        jun12 = spark.sql("SELECT * FROM scoredstream WHERE day = 'Jun12'")
        assert jun12.count() == flows.where("day = 'Jun12'").count()
        assert jun12.where("predictedLabel IS NULL").count() == 0
    finally:
        run.release()
