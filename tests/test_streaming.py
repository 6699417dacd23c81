from pyspark.sql import functions as F

from sawmill.operators.mining import samples
from sawmill.sources.presets import COLLECTIONS, SHARED_MASKS
from sawmill.streaming.online import contents, match_stream, sample_counts, windowed_templates

LINE = "2024-01-01 00:00:0{i} 7 INFO svc.a: user {i} came in"


def stream(spark, folder):
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).withColumn("dataset", F.lit("d")).withColumn("line_no", F.length("value").cast("long"))
    return contents(lines, COLLECTIONS["HDFS"][0], [], SHARED_MASKS)


def write(folder, n, k):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.log").write_text("".join(LINE.format(i=i) + "\n" for i in range(n)) + "no header\n")


def test_counts_equal_batch(spark, tmp_path):
    for k in range(3):
        write(tmp_path / "in", 4, k)
    q = sample_counts(stream(spark, tmp_path / "in")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    lines = spark.read.text(str(tmp_path / "in")).withColumn("dataset", F.lit("d")).withColumn("line_no", F.length("value").cast("long"))
    batch = samples(contents(lines, COLLECTIONS["HDFS"][0], [], SHARED_MASKS))
    want = {(r.sample_text, r.log_num) for r in batch.collect()}
    assert {(r.content, r.log_num) for r in spark.table("counts").collect()} == want == {("user <*> came in", 12)}


def test_matching_goes_on_after_a_restart(spark, tmp_path):
    t = spark.createDataFrame([(5, "user <*> came in", 0)], "template_id long, template_text string, ord int")
    for k in range(2):
        write(tmp_path / "in", 3, k)
        match_stream(stream(spark, tmp_path / "in"), t, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.where("template_id = 5").count() == 6


def test_windows(spark, tmp_path):
    write(tmp_path / "in", 3, 0)
    rows = stream(spark, tmp_path / "in").withColumn("ts", F.to_timestamp(F.concat("Date", F.lit(" "), "Time")))
    q = windowed_templates(rows, "ts", "1 minute", "1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [(r.content, r.n) for r in spark.table("windows").collect()] == [("user <*> came in", 3)]
