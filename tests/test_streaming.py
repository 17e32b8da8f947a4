from pyspark.sql import functions as F

from capturelake.plans.job import JobOptions
from capturelake.streaming import ingest

SCHEMA = "url string, final_url string, status_code int, html string, fetched_at string, seq long, at timestamp, bytes_sha256 string"
LONG = "Words of a streamed page. " * 12


def rows(spark, *pages):
    data = [(f"https://h.org/{k}", f"https://h.org/{k}", 200, f"<main><p>{LONG}{t}</p></main>", "2026-01-01T00:00:00Z", k) for k, t in pages]
    df = spark.createDataFrame(data, "url string, final_url string, status_code int, html string, fetched_at string, seq long")
    return df.withColumns({"at": F.expr("timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, seq)"), "bytes_sha256": F.sha2("html", 256)})


def test_batches_become_jobs(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows(spark, (1, "a"), (2, "b")).coalesce(1).write.parquet(f"{folder}")
    for k, pages in enumerate([[(1, "a"), (2, "b")], [(3, "a"), (4, "c")]]):
        if k:
            rows(spark, *pages).coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.capture_stream(spark, folder, SCHEMA)
        ingest.run_stream(stream.drop("bytes_sha256", "at"), out, str(tmp_path / "state"), JobOptions()).awaitTermination()
    got = {r.seq: r.outcome for r in spark.read.parquet(out).collect()}
    assert got == {1: "saved", 2: "saved", 3: "duplicate", 4: "saved"}


def test_repeats_and_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark, (1, "a"), (2, "a"), (700, "b")).coalesce(1).write.parquet(folder)
    stream = ingest.capture_stream(spark, folder, SCHEMA)
    for name, df in (("once", ingest.deduplicated(stream, "at").select("seq")), ("counts", ingest.windowed_counts(stream, "at"))):
        ingest_mode = "append" if name == "once" else "complete"
        q = df.writeStream.format("memory").queryName(name).outputMode(ingest_mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.seq for r in spark.table("once").collect())[-1] == 700 and spark.table("once").count() == 2
    assert sorted((r.status, r.n) for r in spark.table("counts").collect()) == [("2xx", 1), ("2xx", 2)]
    once = ingest.converted_stream(stream).select("markdown").writeStream.format("memory").queryName("md").option("checkpointLocation", str(tmp_path / "md")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("md").where("markdown like 'Words%'").count() == 3
