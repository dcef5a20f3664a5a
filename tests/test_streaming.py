from docloom.operators.htmlmd import html_to_markdown
from docloom.sources import files
from docloom.streaming.convert import html_stream, run_counts, write_once


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"{i}.html").write_text(f"<h1>{i}</h1><p>x")
    write_once(html_stream(files.stream_files(spark, str(src), "*.html", 2)), str(tmp_path / "out"), str(tmp_path / "ck"))
    write_once(html_stream(files.stream_files(spark, str(src), "*.html", 2)), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.path: r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    from pyspark.sql import functions as F

    batch = html_to_markdown(files.read_files(spark, str(src)).select("path", F.decode("content", "UTF-8").alias("h")), "path", "h")
    assert got == {r.path: r.markdown for r in batch.collect()} and len(got) == 5


def test_run_counts(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/extract_runs.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "runs"))
    stream = run_counts(stream, late="3650 days")
    q = stream.writeStream.format("memory").queryName("rc").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("rc").collect()}
    assert got == {tuple(r) for r in run_counts(table).collect()}
