import tempfile

from conftest import SMALL, rows
from pyspark.sql import functions as F

from inkframe import bindings as B
from inkframe.operators import memory as M
from inkframe.operators import pages as P
from inkframe.operators import votes as V
from inkframe.streaming import logs, recognition


def tmp():
    return tempfile.mkdtemp(prefix="spark-")


def as_stream(spark, df, parts=3):
    d = tmp()
    df.repartition(parts).write.mode("overwrite").parquet(d)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(d)


def test_progress_equals_batch(spark, tables):
    e = tables.events.selectExpr("user_id AS page_id", "length(event_type) AS status_rank", "ts")
    out = tmp()
    logs.stream_progress(as_stream(spark, e), out, tmp()).awaitTermination(120)
    assert rows(logs.progress_now(spark, out)) == rows(logs.page_progress(e))


def test_audit_retention_equals_batch(spark, tables):
    a = B.audit(tables)
    out = tmp()
    logs.stream_audit(as_stream(spark, a, 1), out, tmp()).awaitTermination(120)
    assert rows(logs.retained(spark, out, 20), "id") == rows(P.retain(a, 20), "id")


def test_consensus_equals_batch(spark, tables):
    v = B.votes(tables).withColumn("item_id", F.concat_ws(":", "user_id", "day", "item")).drop(*B.VOTE_KEYS)
    counts = v.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    full = v.join(counts.where("n = 3"), "item_id")
    # complete items are emitted in the run that brings their third round
    s = full.select("item_id", F.col("round").cast("long").alias("round"), "char", "confidence", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    out = tmp()
    recognition.stream_consensus(as_stream(spark, s), out, tmp()).awaitTermination(180)
    want = V.consensus(full, ["item_id"]).select("item_id", "char", "confidence", "note")
    assert rows(spark.read.parquet(out), "item_id", "char", "confidence", "note") == rows(want)


def test_settled_items_stay_settled(spark):
    at = "2024-01-01 00:{:02d}:00"
    votes = [("a", 1, "公", 0.5, 0), ("a", 2, "公", 0.5, 0), ("a", 2, "氏", 0.4, 0), ("a", 3, "公", 0.5, 1), ("b", 1, "世", 0.9, 0)]
    again = [("a", 1, "公", 0.5, 2), ("a", 3, "祖", 0.9, 3)]
    far = [("z", r, "公", 0.9, 59) for r in (1, 2, 3)]
    d = tmp()
    schema = "item_id string, round long, char string, confidence double, m int"
    for k, part in enumerate((votes, again, far, [("y", 1, "公", 0.9, 59)])):
        df = spark.createDataFrame([(*v[:4], at.format(v[4])) for v in part], "item_id string, round long, char string, confidence double, t string")
        df.select("item_id", "round", "char", "confidence", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(d)
        import time

        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema.replace("m int", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(d)
    out = tmp()
    recognition.stream_consensus(stream, out, tmp()).awaitTermination(180)
    got = {r["item_id"]: r for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(got) and set(got) >= {"a", "z", "b"}
    full = spark.createDataFrame([v[:4] for v in votes if v[0] == "a"], "item_id string, round long, char string, confidence double")
    assert got["a"]["char"] == V.consensus(full, ["item_id"]).first()["char"]
    assert got["b"]["confidence"] <= 0.5


def test_learn_equals_batch_and_ignores_repeats(spark, tables):
    from inkframe.catalog.matching import evidence

    e = evidence(tables)
    empty = spark.createDataFrame([], "project_id long, aspect long, sig array<long>, char string, total long, manual long, model long, local long, confidence_sum double, last_seen long, evidence_keys array<string>")
    out = tmp()
    recognition.stream_learn(as_stream(spark, e.unionByName(e), 2), out, tmp(), empty, "40 days").awaitTermination(180)
    import glob

    last = sorted(glob.glob(out + "/version=*"), key=lambda p: int(p.split("=")[-1]))[-1]
    cols = ["project_id", "aspect", "char", "total"]
    assert rows(spark.read.parquet(last), *cols) == rows(M.learn(empty, e), *cols)


def test_new_work_only_for_changed_sets(spark):
    p = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "project_id long, page_id long")
    stored = P.id_signature(p.where("page_id <> 2"), ["project_id"], "page_id").select("project_id", "signature")
    assert rows(logs.new_work(p, stored, ["project_id"], "page_id"), "project_id") == [(1,)]
