import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.alerts import rises
from riskloom.plans import catalog
from riskloom.session import work_folder
from riskloom.streaming import calls as live
from riskloom.streaming.batches import BatchTable


def test_rises_across_spans_and_calls(spark):
    levels = ["low", "medium", "medium", "high", "low", "high", "high", "medium", "high"]
    rows = [(c, f"2024-01-{1 + i * 7 // 24 + c:02d} {i * 7 % 24:02d}:00:00", lv) for c in (1, 2) for i, lv in enumerate(levels)]
    df = spark.createDataFrame(rows, "call_id bigint, s string, risk_level string").withColumn("window_start", F.to_timestamp("s"))
    df = df.withColumn("window_end", F.col("window_start") + F.expr("interval 1 hour"))
    got = {c: [r["risk_level"] for r in rises(df.repartition(5), "call_id", "window_start", "window_end", "risk_level", span).filter(F.col("call_id") == c).orderBy("window_start").collect()]
           for c in (1, 2) for span in ("1 day", "10 hours")}
    assert got == {1: ["medium", "high", "high", "high"], 2: ["medium", "high", "high", "high"]}


def rows_of(df):
    return sorted(map(str, df.collect()))


def plain_windows(rows, size, slide):
    """(call, window start, text) by brute force; times in microseconds."""
    out = {}
    for call, utt, us, text in rows:
        if us is not None:
            for start in range((us // slide) * slide, us - size, -slide):
                out.setdefault((call, start), []).append((us, utt, text))
    return sorted((str(c), s, "".join(t for _, _, t in sorted(said) if t)) for (c, s), said in out.items())


@pytest.mark.parametrize("size, slide, panes", [("10 seconds", "5 seconds", 4), ("60 seconds", "5 seconds", 8), ("5 seconds", "5 seconds", 256), ("40 seconds", "2 seconds", 3)])
def test_windows_from_panes(spark, size, slide, panes, monkeypatch):
    """Blocks smaller and larger than a window, before and after 1970, on the edges of panes; repeated rows, nulls, a hot call."""
    monkeypatch.setattr(live._pane_windows, "__defaults__", (panes,))
    rng = random.Random(6)
    times = [rng.choice([-7_000_000, 0, 1_704_067_200_000_000]) + rng.randrange(-90, 90) * 1_000_000 + rng.choice([0, 0, -1, 1]) for _ in range(400)]
    rows = [(None if i % 50 == 0 else 1 if i % 3 else i % 7, i // 2, us, f"<{i}>") for i, us in enumerate(times)]
    rows += rows[:5] + [(1, 900, None, "no time"), (2, 901, 5, None), (2, 902, 5, "")]
    # a null text sorts with the others of its place and adds nothing
    df = spark.createDataFrame(rows, "call_id long, utt_id long, us long, text string").selectExpr("call_id", "utt_id", "timestamp_micros(us) as ts", "text", "1 as _block", "2 as block").repartition(3)
    got = live.transcript_windows(df, size, slide)
    found = got.select(F.col("call_id"), F.unix_micros("window_start"), "text", (F.unix_micros("window_end") - F.unix_micros("window_start")).alias("n")).collect()
    want = plain_windows([(c, u, us, t or "") for c, u, us, t in rows], *(int(x.split()[0]) * 10**6 for x in (size, slide)))
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == want and {r["n"] for r in found} == {int(size.split()[0]) * 10**6}
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert live.transcript_windows(df.where("false"), size, slide).count() == 0


def test_windows_that_no_panes_fill(spark):
    """Seven seconds every two: the size is no multiple of the slide."""
    rows = [(1, i, i * 1_300_000, f"<{i}>") for i in range(40)]
    df = spark.createDataFrame(rows, "call_id long, utt_id long, us long, text string").selectExpr("call_id", "utt_id", "timestamp_micros(us) as ts", "text")
    got = live.transcript_windows(df, "7 seconds", "2 seconds").select("call_id", F.unix_micros("window_start").alias("s"), "text").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == plain_windows(rows, 7_000_000, 2_000_000)


@pytest.mark.parametrize("cuts", [1, 3, 9])
def test_stream_of_panes(spark, tmp_path, cuts, monkeypatch):
    """Pieces in any number of micro-batches, each started anew: windows of a minute every five seconds equal brute force.

    Blocks are small; calls without an id, repeated pieces, null texts and ids, and a call in many blocks are there.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    monkeypatch.setattr(live._pane_stream, "__defaults__", (16,))
    rng = random.Random(cuts)
    base = 1_704_067_200_000_000
    rows = [(None if i % 40 == 0 else 1 if i % 3 else i % 5, i // 2, base + i * 1_700_000 + rng.randrange(-20_000_000, 20_000_000), f"<{i}>") for i in range(300)]
    rows += [(1, 900, base, None), (1, None, base, "first"), (2, 2**53 + 1, base + 5, "b"), (2, 2**53, base + 5, "a"), (4, 1, None, "no time")] + rows[20:23]
    shape, source, path = "call_id bigint, utt_id bigint, us bigint, text string", f"{tmp_path}/in", f"{tmp_path}/out"
    # in the order of time, so that nothing is late by more than the delay
    rows.sort(key=lambda r: r[2] or base)
    step = -(-len(rows) // cuts)
    for at in [*range(0, len(rows), step), None]:
        part = [(-1, -1, base + 10**13, "")] if at is None else rows[at : at + step]
        spark.createDataFrame(part, shape).selectExpr("call_id", "utt_id", "timestamp_micros(us) ts", "text").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("call_id bigint, utt_id bigint, ts timestamp, text string").parquet(source)
        live.run_to_table(live.transcript_windows(stream, "60 seconds", "5 seconds", late="60 seconds"), path, f"{tmp_path}/mark")
    found = spark.read.parquet(path).select("call_id", F.unix_micros("window_start"), "text", (F.unix_micros("window_end") - F.unix_micros("window_start")).alias("n")).collect()
    said = [r for r in rows if r[2] is not None]
    # a piece without a number comes before the others of its time
    want = plain_windows([(c, -1 if u is None else u, us, t or "") for c, u, us, t in said], 60_000_000, 5_000_000)
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == want and {r["n"] for r in found} == {60_000_000}


def test_late_pieces_of_panes(spark, tmp_path):
    """A piece behind the watermark is in its open windows only, and no closed window leaves again. The state holds each piece once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    source, path, base = f"{tmp_path}/in", f"{tmp_path}/out", 1_704_067_200
    batches = [[(1, 0, "a"), (1, 58, "b")], [(1, 100, "c")], [(1, 85, "late"), (1, 20, "lost")], [(1, 400, "z")]]
    held = []
    for said in batches:
        rows = [(c, i, base + s, t) for i, (c, s, t) in enumerate(said)]
        spark.createDataFrame(rows, "call_id bigint, utt_id bigint, s bigint, text string").selectExpr("call_id", "utt_id", "timestamp_seconds(s) ts", "text").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("call_id bigint, utt_id bigint, ts timestamp, text string").parquet(source)
        live.run_to_table(live.transcript_windows(stream, "40 seconds", "5 seconds", late="1 second"), path, f"{tmp_path}/mark")
        state = spark.read.format("statestore").option("stateVarName", "panes").load(f"{tmp_path}/mark")
        held.append(state.select(F.sum(F.size("user_map_value.us"))).first()[0])
    got = [(r["s"] - base, r["text"]) for r in spark.read.parquet(path).selectExpr("unix_seconds(window_start) s", "text").collect()]
    assert len(got) == len({s for s, _ in got})
    by = dict(got)
    assert by[0] == "a" and by[20] == "b" and by[55] == "b" and by[60] == "late" and by[65] == "latec" and by[85] == "latec" and by[90] == "c"
    assert not any("lost" in t for t in by.values())
    assert held == [1, 1, 2, 1]


def test_stream_equals_table(spark, data):
    """Windows, scores and alerts run as one stream give what the table plan gives."""
    assert rows_of(catalog.stream_alerts(spark, data)) == rows_of(catalog.risk_escalation(spark, data))


def test_silence_ends_a_call_however_the_stream_is_cut(spark):
    """A high window, silence longer than is kept, a high window: two alerts from table and stream alike."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    hours = [(1, 1, "high"), (1, 2, "high"), (2, 3, "medium"), (2, 9, "low"), (2, 20, "medium"), (1, 30, "high"), (1, 33, "medium"), (1, 34, "high")]
    shape = live.ALERT
    df = spark.createDataFrame(hours, "call_id bigint, h int, risk_level string").selectExpr(
        "call_id", "timestamp_seconds(1704067200 + h * 3600) as window_start", "timestamp_seconds(1704067200 + h * 3600 + 3600) as window_end",
        "risk_level", "0.5D as risk_score", "'x' as fraud_type",
    )
    want = rows_of(rises(df, "call_id", "window_start", "window_end", "risk_level").select("call_id", "window_start"))
    assert len(want) == 5
    for parts in (1, 4):
        path, out = work_folder(spark, "gap"), work_folder(spark, "gap-out")
        ordered = [r for r in sorted(df.collect(), key=lambda r: r["window_start"])]
        size = -(-len(ordered) // parts)
        for i in range(0, len(ordered), size):
            spark.createDataFrame(ordered[i : i + size], shape).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("window_end", "1 minute")
        live.run_to_table(live.rise_alerts(stream), out, work_folder(spark, "gap-mark"))
        assert rows_of(spark.read.schema(shape).parquet(out).select("call_id", "window_start")) == want


def test_two_stage_alerts_over_pieces_and_restarts(spark, data):
    """Four micro-batches of either stage, each after a restart, give what the table plan gives."""
    assert rows_of(catalog.stream_alerts_partitioned(spark, data)) == rows_of(catalog.risk_escalation(spark, data))


def test_batches_appear_whole_and_once(spark):
    table = BatchTable(spark, work_folder(spark, "batches"), spark.range(1).schema)
    assert table.read().collect() == [] and table.numbers() == []
    assert table.add(0, lambda: spark.range(3)) and table.add(2, lambda: spark.range(5, 7))
    assert not table.add(0, lambda: spark.range(100))  # a repeated micro-batch

    def lost():
        def fail(batches):
            yield from batches
            raise RuntimeError("lost")

        return spark.range(50, 60).mapInArrow(fail, "id long")

    with pytest.raises(Exception, match="lost"):
        table.add(3, lost)
    assert table.numbers() == [0, 2] and rows_of(table.read()) == rows_of(spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6)], "id long"))
    assert table.add(3, lambda: spark.range(50, 51)) and table.read().count() == 6


def test_a_repeated_micro_batch_alerts_once(spark, monkeypatch):
    """The driver is lost after a batch was stored and before its checkpoint was: the batch runs again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    path, source = work_folder(spark, "again"), work_folder(spark, "again-in")
    spark.createDataFrame([(1, h, "我是公安局的，你涉嫌洗钱，要保密，请配合调查，把钱转到安全账户" if h in (1, 5) else "好的") for h in range(8)] + [(-1, 10**6, "")], "call_id bigint, h bigint, text string").selectExpr(
        "call_id", "h as utt_id", "timestamp_seconds(1704067200 + h * 3600) as ts", "text").write.parquet(source)
    cases = spark.createDataFrame([], live_cases())
    windows = lambda: live.transcript_windows(spark.readStream.schema("call_id bigint, utt_id bigint, ts timestamp, text string").parquet(source), "1 hour", "1 hour", late="1 hour")
    real = BatchTable.add

    def stored_then_lost(self, number, rows, by=None):
        done = real(self, number, rows, by)
        if self.read().count():
            raise RuntimeError("driver lost")
        return done

    monkeypatch.setattr(BatchTable, "add", stored_then_lost)
    for _ in range(2):
        with pytest.raises(Exception, match="driver lost"):
            live.alert_stream(windows(), cases, path)
        monkeypatch.setattr(BatchTable, "add", lambda self, n, rows, by=None: stored_then_lost(self, n, rows, by) if "alerts" in self.path else real(self, n, rows, by))
    monkeypatch.setattr(BatchTable, "add", real)
    got = live.alert_stream(windows(), cases, path).select("call_id", "risk_level", F.hour("window_start").alias("h")).collect()
    assert sorted(r["h"] for r in got) == [1, 5] and {r["risk_level"] for r in got} <= {"medium", "high"}


def live_cases():
    from riskloom.schemas import CASE_TABLE

    return CASE_TABLE


def test_state_outlives_windows_that_are_still_open(spark):
    """Another call moves the watermark past the silence kept, while a window that began before is open."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    path = work_folder(spark, "open")
    table = BatchTable(spark, path, spark.createDataFrame([], live.ALERT).schema)
    for number, (call, hour) in enumerate([(1, 0), (2, 7), (1, 8), (2, 30), (1, 40)]):
        row = spark.createDataFrame([(call, hour)], "call_id bigint, h int").selectExpr(
            "call_id", "timestamp_seconds(1704067200 + h * 3600) as window_start", "timestamp_seconds(1704067200 + h * 3600 + 7200) as window_end",
            "'high' as risk_level", "0.8D as risk_score", "'x' as fraud_type",
        )
        table.add(number, lambda row=row: row)
        live.run_to_table(live.rise_alerts(table.stream().withWatermark("window_end", "0 seconds")), f"{path}-out", f"{path}-mark")
    want = rows_of(rises(table.read(), "call_id", "window_start", "window_end", "risk_level"))
    assert len(want) == 4 and rows_of(spark.read.schema(live.ALERT).parquet(f"{path}-out")) == want


@pytest.mark.parametrize("most", [20_000, 300])
def test_long_calls_are_sorted_in_bounded_memory(spark, most):
    """One call of thousands of windows in one micro-batch, in no order; a small bound sends it through the state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    path = work_folder(spark, "long")
    rows = spark.range(4000).selectExpr(
        "case when id < 3500 then 1L else 2L end as call_id", "timestamp_seconds(1704067200 + id * 5) as window_start", "timestamp_seconds(1704067200 + id * 5 + 10) as window_end",
        "element_at(array('low', 'medium', 'high'), cast(pmod(xxhash64(id), 3) as int) + 1) as risk_level", "0.5D as risk_score", "'x' as fraud_type",
    )
    table = BatchTable(spark, path, spark.createDataFrame([], live.ALERT).schema)
    for number, condition in enumerate(("id < 3990", "id >= 3990")):
        table.add(number, lambda c=condition: rows.where(c.replace("id", "(unix_seconds(window_start) - 1704067200) / 5")).repartition(7, F.xxhash64("window_start")))
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
        live.run_to_table(live.rise_alerts(table.stream().withWatermark("window_end", "0 seconds"), most=most), f"{path}-out", f"{path}-mark")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = rows_of(rises(table.read(), "call_id", "window_start", "window_end", "risk_level"))
    assert len(want) > 500 and rows_of(spark.read.schema(live.ALERT).parquet(f"{path}-out")) == want


def test_many_calls_share_few_groups_of_state(spark):
    """Calls of one bucket, a call without a name among them, rise and end as in the table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    path = work_folder(spark, "buckets")
    rows = spark.range(3000).selectExpr(
        "nullif(pmod(xxhash64(id), 200), 7) + 9007199254740993 as call_id", "timestamp_seconds(1704067200 + id * 600) as window_start",
        "timestamp_seconds(1704067200 + id * 600 + 3600) as window_end", "element_at(array('low', 'medium', 'high'), cast(pmod(xxhash64(id, 1), 3) as int) + 1) as risk_level",
        "0.5D as risk_score", "'x' as fraud_type",
    )
    table = BatchTable(spark, path, spark.createDataFrame([], live.ALERT).schema)
    for number in range(3):
        table.add(number, lambda n=number: rows.where(f"(unix_seconds(window_start) - 1704067200) div 600000 = {n}").repartition(5, F.xxhash64("window_start")))
        rising = live.rise_alerts(table.stream().withWatermark("window_end", "0 seconds"), buckets=3)
        live.run_to_table(rising, f"{path}-out", f"{path}-mark")
    named = lambda df: df.withColumn("call_id", F.coalesce("call_id", F.lit(-1)))
    want = rows_of(rises(named(table.read()), "call_id", "window_start", "window_end", "risk_level"))
    assert len(want) > 500 and rows_of(named(spark.read.schema(live.ALERT).parquet(f"{path}-out"))) == want
