"""Flows that end and go on, and tables that are published as a whole."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumeflow.sources import shared, versions
from plumeflow.streaming import flows

MAIL = "id long, sender string, subject string"


def table(df):
    return sorted(map(str, df.collect()))


def undone(checkpoint):
    """Takes back the last commit, as if the run had ended between sink and commit."""
    last = max((p for p in Path(checkpoint, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)


def test_mail_flow(spark, tmp_path):
    reason = F.when(F.col("subject").isNull(), "no subject")
    inbox, out, checkpoint = (f"{tmp_path}/{k}" for k in ("in", "out", "checkpoint"))
    first = [(1, "a", "x"), (2, "a", "x"), (3, "b", None), (4, None, "y"), (5, None, "y")]
    later = [(6, "a", "x"), (7, None, "y"), (8, "c", "z"), (9, None, None)]
    schema = spark.createDataFrame([], MAIL).schema

    def go_on():
        flows.mail_flow(spark, inbox, schema, checkpoint, out, ["sender", "subject"], reason, files_per_batch=1)
        return [table(flows.read_sink(spark, f"{out}/{k}", MAIL).drop("batch")) for k in ("good", "bad")]

    flows.land(spark.createDataFrame(first, MAIL).repartition(3), inbox)
    go_on()
    flows.land(spark.createDataFrame(later, MAIL).repartition(2), inbox)
    good, bad = go_on()
    keys = sorted((r.sender or "", r.subject) for r in flows.read_sink(spark, f"{out}/good", MAIL).collect())
    assert keys == [("", "y"), ("a", "x"), ("c", "z")]
    assert sorted(r.id for r in flows.read_sink(spark, f"{out}/bad", MAIL).collect()) == [3, 9]
    batches = {r.batch for r in flows.read_sink(spark, f"{out}/good", MAIL).select("batch").distinct().collect()}
    assert go_on() == [good, bad] and len(batches) >= 2
    undone(checkpoint)
    assert go_on() == [good, bad]  # the batch is done again and leaves both tables as they are


def test_followed_log_is_done_again(spark, tmp_path):
    line = '10.0.0.{} - - [05/Jan/2024:0{}:00:01 +0000] "GET {} HTTP/1.1" {} 7 "-" "Mozilla/5.0" "-" rt=0.{} uct="0.1" uht="-" urt="0.2"'
    lines = [(line.format(i % 4, i % 3, "/a" if i % 5 else "/favicon.ico", 500 if i % 7 == 0 else 200, i % 10),) for i in range(60)] + [("garbage",)]
    inbox, out, checkpoint = (f"{tmp_path}/{k}" for k in ("in", "out", "checkpoint"))
    for part in (lines[:20], lines[20:50], lines[50:]):
        flows.land(spark.createDataFrame(part, "line string"), inbox, as_text=True)
        flows.follow_log(spark, inbox, checkpoint, out)
    got = table(flows.band_counts(spark, out))
    undone(checkpoint)
    flows.follow_log(spark, inbox, checkpoint, out)
    assert table(flows.band_counts(spark, out)) == got
    flows.follow_log(spark, inbox, f"{checkpoint}2", f"{out}2")  # all at once
    assert table(flows.band_counts(spark, f"{out}2")) == got and sum(r.n for r in flows.band_counts(spark, out).collect()) == 60


def test_ban_flow_drops_state(spark, tmp_path):
    inbox, out, checkpoint = (f"{tmp_path}/{k}" for k in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], "k string, ts timestamp").schema
    for times in ([0, 5, 6, 7, 8], [9, 50, 51], [4000, 4001, 4002]):
        rows = spark.createDataFrame([(k, t) for k in ("a", "b") for t in times], "k string, s long").select("k", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))
        flows.land(rows, inbox)
        flows.ban_flow(spark, inbox, schema, checkpoint, out, "k", 3, 10, 40, late="1 second")
    got = sorted((r.key, r.from_us // 10**6 - 1000, r.until_us // 10**6 - 1000) for r in flows.read_sink(spark, out, flows.BANNED).collect())
    assert got == [(k, t, t + 40) for k in ("a", "b") for t in (6, 4002)]


def test_publish_takes_a_place_once(spark, tmp_path):
    path = f"{tmp_path}/m/1.json"
    assert shared.publish(spark, path, "one") and not shared.publish(spark, path, "two")
    assert Path(path).read_text() == "one" and shared.names(spark, f"{tmp_path}/m") == [".1.json.crc", "1.json"] or shared.names(spark, f"{tmp_path}/m") == ["1.json"]


def test_snapshot_with_a_crash_between_the_tables(spark, tmp_path, monkeypatch):
    store = versions.Snapshots(spark, str(tmp_path / "s"), "rank int, title string")
    assert store.headers().count() == 0 and store.items().count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "rank int, title string")
    with monkeypatch.context() as m:
        m.setattr(shared, "publish", lambda *a: (_ for _ in ()).throw(ConnectionError("lost")))
        with pytest.raises(ConnectionError):
            store.save("2024-01-01", lambda: rows)
    assert store.headers().count() == 0 and store.items().count() == 0  # items lie there, and nobody sees them
    with pytest.raises(ValueError):
        store.save("2024-01-01", lambda: (_ for _ in ()).throw(ValueError("no report")))
    assert [(r.status, r.n_items, r.error) for r in store.headers().collect()] == [("FAILED", 0, "ValueError")] and store.items().count() == 0
    assert store.save("2024-01-01", lambda: rows) and not store.save("2024-01-01", lambda: rows.limit(1))
    assert [(r.status, r.n_items) for r in store.headers().collect()] == [("SUCCESS", 2)]
    assert table(store.items().select("day", "rank", "title")) == table(rows.select(F.lit("2024-01-01").alias("day"), "rank", "title"))


def test_archive(spark, tmp_path):
    store = versions.Archive(spark, str(tmp_path / "a"))
    rows = lambda *r: spark.createDataFrame(list(r), "user_id long, item string")
    day = "2024-01-01"
    assert store.save(rows((1, "a"), (1, "b"), (2, "c")), day, f"{day} 08:00").count() == 2
    assert store.save(rows((1, "d")), day, f"{day} 09:00").count() == 1
    assert store.save(rows((1, "e"), (2, "f")), day, f"{day} 10:00").collect()[0].user_id == 2  # user 1 had a refresh
    before = table(store.history())
    store.save(rows((1, "e"), (2, "f")), day, f"{day} 10:00")  # again: nothing changes
    assert table(store.history()) == before
    assert sorted((r.user_id, r.item) for r in store.current(day).collect()) == [(1, "d"), (2, "f")]
    for at, want in (("07:00", []), ("08:30", ["a", "b", "c"]), ("09:00", ["c", "d"]), ("23:00", ["d", "f"])):
        assert sorted(r.item for r in store.as_of(f"{day} {at}").collect()) == want
    store.save(rows((3, "g")), "2024-01-02", "2024-01-02 08:00")
    assert store.current(day).count() == 2 and store.current("2024-01-02").count() == 1
    shutil.rmtree(tmp_path / "a")
