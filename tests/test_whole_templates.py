"""Templates of whole bodies: lines that differ in ids only are one, lines that share a beginning are not."""

from pyspark.sql import functions as F

from logweave.plans import log_queries as q


def test_ids_come_from_whole_bodies(spark, tmp_path):
    # two orders in one minute (bodies begin with different digests), and two outages of one beginning, 'kafka: 3/3 brokers ...' and 'elasticsearch ...'
    rows = [(1, 0, "purchase"), (2, 5, "purchase"), (3, 70, "purchase"), (4, 75, "error"), (6, 80, "error")]
    df = spark.createDataFrame(rows, "event_id long, s int, event_type string")
    df = df.select("event_id", F.timestamp_seconds(F.lit(1_800_000_000) + F.col("s")).alias("ts"), F.lit(8).cast("long").alias("user_id"), "event_type", F.lit(1.5).alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path)
    got = {(r.n, r.severity_text) for r in q.template_bursts_whole(spark, folder).collect()}
    assert got == {(2, "INFO"), (2, "ERROR")}
    # the prefix of 12 characters splits the orders
    assert {r.severity_text for r in q.template_bursts(spark, folder).collect()} == {"ERROR"}
    pair = q.cooccurrence_whole(spark, folder).collect()
    assert [(r.n, r.p_a, r.p_b) for r in pair] == [(6, 0.6, 0.4)]
    assert q.first_code_errors_whole(spark, folder).first().template_id in {r.template_id for r in q.template_bursts_whole(spark, folder).where("severity_text = 'ERROR'").collect()}
    assert {r.n for r in q.replay_whole(spark, folder).where("kind = 'template_burst'").collect()} == {2}
