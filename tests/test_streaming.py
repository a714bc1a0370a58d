from paths import SF

from plumeflow.plans import catalog
from plumeflow.streaming import events as st


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp")).repartition(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    return st.event_stream(spark, str(tmp_path / "in"), batch.schema), batch


def test_tumbling_equals_batch(spark, tmp_path):
    s, _ = stream(spark, tmp_path)
    got = run(st.counts_by_window(s, "1 day", "event_type"), "tumbling", "complete").groupBy("event_type").sum("n").collect()
    want = catalog.QUERIES["stm10_tumbling"](spark, SF).groupBy("event_type").sum("n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_first_of_key(spark, tmp_path):
    s, batch = stream(spark, tmp_path)
    assert run(st.first_of_key(s, ["user_id", "event_type"], late="60 days"), "firsts").count() == batch.select("user_id", "event_type").distinct().count()


def test_exact_bans(spark, tmp_path):
    s, batch = stream(spark, tmp_path)
    got = {(r.user_id, r.from_s) for r in run(st.exact_bans(s, "user_id", 3, 36_000, 3600), "bans").collect()}
    want = set()
    rows = sorted((str(r.user_id), r.ts.timestamp()) for r in batch.collect())
    state = {}
    for k, t in rows:
        recent, until = state.get(k, ([], 0))
        if t < until:
            continue
        recent = [x for x in recent if x > t - 36_000] + [t]
        if len(recent) >= 3:
            want.add((k, t))
            recent, until = [], t + 3600
        state[k] = (recent, until)
    assert {(k, round(t, 3)) for k, t in got} == {(k, round(t, 3)) for k, t in want} and got


def test_leaky_bucket(spark, tmp_path):
    assert st.admit([0.0] * 5, 1.0, 2)[0] == [True, True, True, False, False]
    assert st.admit([0.0, 0.0, 0.0, 1.0], 1.0, 1)[0] == [True, True, False, True]
    s, batch = stream(spark, tmp_path)
    out = run(st.rate_limited(s, "user_id", 0.0001, 1), "limited")
    assert out.count() == batch.count() and {r.status for r in out.select("status").distinct().collect()} == {200, 429}
