"""A stream's windows equal those of the same rows in a table."""

from millrace.sources.tables import table
from millrace.streaming.windows import tumbling


def test_stream_equals_batch(spark, small, tmp_path):
    rows = table(spark, small, "events").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "value")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, tumbling(rows).collect()))


def test_command_line(spark, small, capsys):
    from millrace.__main__ import main

    assert main(["--load-parquet", f"cli_region={small}/region.parquet", "--sql", "SELECT COUNT(*) AS n FROM cli_region", "--format", "csv"]) == 0
    assert capsys.readouterr().out.split() == ["n", "5"]
