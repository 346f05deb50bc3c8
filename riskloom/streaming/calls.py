"""Live calls: sliding transcript windows, their scores, and rise alerts."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..lexicon import DEFAULT, Lexicon
from ..operators.alerts import KEEP_MS
from ..operators.similar import TopKOptions, resident_scorer, resident_snapshot
from ..plans.detect import NO_JUDGE, RESULT, RESULT_INFO, assess, detect, valid_transcripts, with_rule_score, with_vector
from ..schemas import RiskOptions
from .batches import BatchTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: From this many windows per piece on, a stream keeps panes: a piece once in the state, in place of once per window.
OVERLAPS = 8


def transcript_windows(
    utterances: DataFrame, size: str = "10 seconds", slide: str = "5 seconds", late: str | None = None, overlaps: int = OVERLAPS
) -> DataFrame:
    """What was said per call and sliding window: (call_id, window_start, window_end, text).

    Input: utterances(call_id, utt_id, ts, text). Pieces are joined in (ts, utt_id)
    order. The same function serves a table and a stream; a stream needs `late`, the
    delay after which a piece is dropped and its windows close. Windows whose size is a
    multiple of their slide are put together from panes, of a table by `_pane_windows`, of a
    stream by `_pane_stream`, which needs the RocksDB state store as `rise_alerts` does. A
    stream whose windows overlap fewer than `OVERLAPS` times keeps a piece once per window, in
    Spark's own window state. Pieces without a time are in no window.
    """
    if isinstance(utterances.schema["ts"].dataType, T.TimestampType):
        span, step = (_micros(utterances.sparkSession, length) for length in (size, slide))
        if span % step == 0 and not utterances.isStreaming:
            return _pane_windows(utterances, step, span // step)
        if span % step == 0 and step % 1000 == 0 and late and span // step >= overlaps:
            return _pane_stream(utterances, step, span // step, late)
    if late:
        utterances = utterances.withWatermark("ts", late)
    said = F.array_sort(F.collect_list(F.struct("ts", "utt_id", "text")))
    grouped = utterances.groupBy("call_id", F.window("ts", size, slide).alias("w")).agg(said.alias("said"))
    return grouped.select(
        "call_id",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        F.array_join(F.transform("said", lambda s: s["text"]), "").alias("text"),
    )


#: Panes whose windows are put together in one group of rows.
BLOCK_PANES = 256


def _micros(spark: SparkSession, length: str) -> int:
    return spark.sql(f"select unix_micros(timestamp_seconds(0) + interval {length})").first()[0]


def _whole(column: str, size: int) -> Column:
    """column / size, rounded down."""
    return F.expr(f"({column} - pmod({column}, {size}L)) div {size}L")


def _pane_windows(utterances: DataFrame, step: int, n: int, panes: int = BLOCK_PANES) -> DataFrame:
    """Windows of `n` panes of `step` microseconds each, one shuffle for all of it.

    Time is cut into blocks of panes, and a piece goes to the block of its pane, near the start of a block
    also to the one before, whose last windows reach into it: of n copies of each piece, one for each of its
    windows, 1 + (n - 1) / panes are shuffled. Inside a block the pieces of a pane are sorted once, and windows join
    the panes next to each other. A call's blocks lie in different tasks, so a call of any length is split.
    """
    whole = _whole
    said = utterances.where(F.col("ts").isNotNull()).select("call_id", "ts", "utt_id", "text", F.unix_micros("ts").alias("_us"))
    said = said.withColumn("_pane", whole("_us", step)).withColumn("_first", F.col("_pane") - (n - 1))
    blocks = F.sequence(whole("_first", panes), whole("_pane", panes))
    rows = said.withColumn("_block", F.explode(blocks)).repartition("call_id", "_block")
    sorted_panes = rows.groupBy("call_id", "_block", "_pane").agg(
        F.array_sort(F.collect_list(F.struct("ts", "utt_id", "text"))).alias("_said")
    )
    starts = F.sequence(
        F.greatest(F.col("_pane") - (n - 1), F.col("_block") * panes), F.least(F.col("_pane"), F.col("_block") * panes + (panes - 1))
    )
    joined = sorted_panes.withColumn("_start", F.explode(starts)).groupBy("call_id", "_block", "_start").agg(
        F.array_sort(F.collect_list(F.struct("_pane", "_said"))).alias("_parts")
    )
    pieces = F.flatten(F.transform("_parts", lambda p: p["_said"]))
    return joined.select(
        "call_id",
        F.timestamp_micros(F.col("_start") * step).alias("window_start"),
        F.timestamp_micros((F.col("_start") + n) * step).alias("window_end"),
        F.array_join(F.transform(pieces, lambda s: s["text"]), "").alias("text"),
    )


class PaneWindows(StatefulProcessor):
    """Windows of the pieces of one block of one call; every piece lies in the state once, in its pane.

    A window closes when the watermark passes its end. There is one timer, for the earliest window that is
    still open and not empty. When it expires, all closed windows leave together and the panes that no open window
    needs are removed. A piece all of whose windows have closed is dropped; one that is late for some of them
    is in the others, as with windows grouped one by one.
    """

    def __init__(self, step_ms: int, n: int, panes: int):
        self.step_ms, self.n, self.panes = step_ms, n, panes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getMapState("panes", "pane bigint, part int", "us array<bigint>, utt array<string>, text array<string>")
        # windows up to `closed` are done with; `due` is the time of the timer
        self.mark = handle.getValueState("mark", "closed bigint, due bigint")

    def _closed(self, timerValues) -> int:
        """The last window whose end the watermark has passed."""
        return timerValues.getCurrentWatermarkInMs() // self.step_ms - self.n

    def _first_open(self, panes: Iterable[int], block: int, closed: int) -> int:
        return max(min(panes) - self.n + 1, block * self.panes, closed + 1)

    def _set(self, closed: int, window: int, due: int | None) -> None:
        at = (window + self.n) * self.step_ms
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            due = at
        self.mark.update((closed, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block, passed = int(key[2]), self._closed(timerValues)
        last = (block + 1) * self.panes - 1
        closed, due = self.mark.get() or (passed, None)
        parts: dict[int, int] = {}
        if due is not None:
            for pane, part in self.said.keys():
                parts[pane] = max(parts.get(pane, 0), part + 1)
        fresh = []
        for frame in rows:
            for pane, some in frame.groupby("pane"):
                pane = int(pane)
                if min(pane, last) > passed:
                    self.said.updateValue((pane, parts.get(pane, 0)), (some["us"].tolist(), some["utt"].tolist(), some["text"].tolist()))
                    parts[pane] = parts.get(pane, 0) + 1
                    fresh.append(pane)
        if fresh:
            self._set(closed, self._first_open(fresh, block, closed), due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        block, passed = int(key[2]), self._closed(timerValues)
        first, last = block * self.panes, (block + 1) * self.panes - 1
        closed, _ = self.mark.get()
        held: dict[int, list] = {}
        for (pane, part), pieces in self.said.iterator():
            held.setdefault(pane, []).append((part, pieces))
        windows = {s for pane in held for s in range(max(pane - self.n + 1, first, closed + 1), min(pane, last, passed) + 1)}
        out: dict[str, list] = {"none": [], "call": [], "start": [], "us": [], "utt": [], "text": []}
        for s in sorted(windows):
            here = [pieces for pane in range(s, s + self.n) for _, pieces in held.get(pane, [])]
            for name, values in zip(out, (key[0], key[1], s, *([v for p in here for v in p[i]] for i in range(3))), strict=True):
                out[name].append(values)
        for pane in [p for p in held if min(p, last) <= passed]:
            for part, _ in held.pop(pane):
                self.said.removeKey((pane, part))
        if held:
            self._set(passed, self._first_open(held, block, passed), None)
        else:
            self.mark.clear()
        if windows:
            end = pd.to_datetime((pd.Series(out["start"]) + self.n) * self.step_ms, unit="ms", utc=True)
            yield pd.DataFrame({**out, "window_end": end})

    def close(self) -> None:
        pass


def _pane_stream(utterances: DataFrame, step: int, n: int, late: str, panes: int = BLOCK_PANES) -> DataFrame:
    """Windows of `n` panes of `step` microseconds each, of a stream: the state holds a piece once.

    As in a table, time is cut into blocks of panes, so a call that never ends is many groups; a piece near the
    start of a block is in the state of the one before as well: 1 + (n - 1) / panes times on average, not n times.
    """
    shape = utterances.schema
    said = utterances.withWatermark("ts", late).where(F.col("ts").isNotNull()).withColumn("us", F.unix_micros("ts"))
    said = said.withColumn("pane", _whole("us", step)).withColumn("_first", F.col("pane") - (n - 1))
    call, utt = F.col("call_id").cast("string"), F.col("utt_id").cast("string").alias("utt")
    none = F.col("call_id").isNull().alias("none")
    # the time goes in as a number: a piece late for one of its windows is not late for all
    rows = said.select(
        none, F.coalesce(call, F.lit("")).alias("call"), F.explode(F.sequence(_whole("_first", panes), _whole("pane", panes))).alias("block"),
        "pane", "us", utt, "text",
    )
    found = rows.groupBy("none", "call", "block").transformWithStateInPandas(
        statefulProcessor=PaneWindows(step // 1000, n, panes),
        outputStructType="none boolean, call string, start bigint, us array<bigint>, utt array<string>, text array<string>, window_end timestamp",
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="window_end",
    )
    piece = lambda us, utt, text: F.struct(us.alias("us"), utt.cast(shape["utt_id"].dataType).alias("utt"), text.alias("text"))
    zipped = F.transform(F.arrays_zip("us", "utt", "text"), lambda s: piece(s["us"], s["utt"], s["text"]))
    return found.select(
        F.when(~F.col("none"), F.col("call").cast(shape["call_id"].dataType)).alias("call_id"),
        F.timestamp_micros(F.col("start") * step).alias("window_start"),
        "window_end",
        F.array_join(F.transform(F.array_sort(zipped), lambda s: s["text"]), "").alias("text"),
    )


def score_windows(
    windows: DataFrame,
    cases: DataFrame,
    lexicon: Lexicon = DEFAULT,
    options: RiskOptions = RiskOptions(),
    topk: TopKOptions = TopKOptions(),
) -> DataFrame:
    """Risk result of every window. A table of windows is scored against cases of any size.

    A stream is scored inside its plan, against a snapshot of the case table taken at its
    start; that takes a case table within the resident bound. `score_stream` and `alert_stream`
    run a stream against cases of any size, one micro-batch at a time.
    """
    if not windows.isStreaming:
        found = detect(windows, cases, "call_id", lexicon=lexicon, options=options, topk=topk)
        return found.select(*windows.columns, *RESULT)
    snapshot = resident_snapshot(cases, RESULT_INFO, topk)
    if snapshot is None:
        raise ValueError("case table exceeds the resident bound: use score_stream or alert_stream")
    scorer = resident_scorer(windows.sparkSession, snapshot, cases, options.top_k, RESULT_INFO, topk)
    said, _ = valid_transcripts(windows)
    scored = with_vector(with_rule_score(said, lexicon), options).withColumn("similar", scorer(F.col("vec")))
    return assess(scored.withColumn("judge", F.lit(None).cast(NO_JUDGE)), options).select(*windows.columns, *RESULT)


class RiseAlert(StatefulProcessor):
    """Keeps the last level of every call of a bucket; emits windows whose level rises to medium or high.

    A call of its own for each group costs more than ten milliseconds a micro-batch, whatever it does. So calls are dealt
    into buckets by hash, and all calls of a bucket are taken together in arrays: what is held of a call stands before its
    windows, and the row before a window says what it follows.

    A micro-batch promises no order, so the windows of a bucket that closed since the last one are sorted by
    call and start. Up to `most` of them are sorted in memory. Beyond that, windows go to the state store by span of
    time, and the spans are taken from it in order, each small: a call of any length needs bounded memory.
    """

    RANKS = {"low": 0, "medium": 1, "high": 2}
    SPAN_MS = 3600 * 1000
    #: What is held of the calls of a bucket, one array each; `due` is the time from which nothing can follow.
    HELD = {"none": bool, "call": np.int64, "rank": np.int64, "end": np.int64, "due": np.int64}

    def __init__(self, keep_ms: int, most: int = 100_000):
        self.keep_ms, self.most = keep_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one timer a bucket, for the call that is due first
        self.last = handle.getValueState("last", "calls binary, due bigint")
        self.spans = handle.getMapState("spans", "span bigint, part int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, held, parts = [], 0, {}
        for frame in rows:
            frames.append(frame)
            held += len(frame)
            if held > self.most:
                self._put_by(frames, parts)
                frames, held = [], 0
        if parts:
            self._put_by(frames, parts)
        batches = (self._take(span, parts[span]) for span in sorted(parts)) if parts else [frames]
        calls, due = self._held()
        for batch in batches:
            calls, out = self._risen(calls, pd.concat(batch, ignore_index=True))
            if len(out):
                yield out
        self._hold(calls, due, timerValues.getCurrentWatermarkInMs())

    def _put_by(self, frames: list[pd.DataFrame], parts: dict[int, int]) -> None:
        if frames:
            whole = pd.concat(frames)
            for span, some in whole.groupby(whole["start_ms"] // self.SPAN_MS):
                self.spans.updateValue((int(span), parts.get(int(span), 0)), (pickle.dumps(some),))
                parts[int(span)] = parts.get(int(span), 0) + 1

    def _take(self, span: int, n: int) -> list[pd.DataFrame]:
        out = [pickle.loads(self.spans.getValue((span, part))[0]) for part in range(n)]
        for part in range(n):
            self.spans.removeKey((span, part))
        return out

    def _held(self) -> tuple[dict[str, np.ndarray], int | None]:
        stored = self.last.get()
        if stored is None:
            return {name: np.zeros(0, kind) for name, kind in self.HELD.items()}, None
        return pickle.loads(stored[0]), stored[1]

    def _hold(self, calls: dict[str, np.ndarray], due: int | None, passed: int) -> None:
        """Store the calls that a window may still follow, with a timer for the first that is due."""
        live = calls["due"] > passed
        calls = {name: values[live] for name, values in calls.items()}
        first = int(calls["due"].min()) if live.any() else None
        if due is not None and due != first and due > passed:
            self.handle.deleteTimer(due)
        if first is None:
            self.last.clear()
            return
        if first != due:
            self.handle.registerTimer(first)
        self.last.update((pickle.dumps(calls), first))

    def _risen(self, calls: dict[str, np.ndarray], batch: pd.DataFrame) -> tuple[dict[str, np.ndarray], pd.DataFrame]:
        """(what is held of the calls afterwards, the windows that rise)."""
        n, rows = len(calls["call"]), len(batch)
        start, end = (np.concatenate([np.zeros(n, np.int64), batch[name].to_numpy(np.int64)]) for name in ("start_ms", "end_ms"))
        end[:n] = calls["end"]
        none = np.concatenate([calls["none"], batch["none"].to_numpy(bool)])
        call = np.concatenate([calls["call"], batch["call"].to_numpy(np.int64)])
        rank = np.concatenate([calls["rank"], batch["risk_level"].map(self.RANKS).to_numpy(np.int64)])
        due = np.concatenate([calls["due"], np.zeros(rows, np.int64)])
        # a window that starts within keep_ms of this end has closed by then
        due[n:] = 2 * end[n:] - start[n:] + self.keep_ms + 1
        fresh = np.arange(n + rows) >= n
        at = np.lexsort((start, fresh, call, none))
        none, call, rank, start, end, due = (x[at] for x in (none, call, rank, start, end, due))
        follows = np.zeros(n + rows, bool)
        follows[1:] = (call[1:] == call[:-1]) & (none[1:] == none[:-1])
        follows[1:] &= start[1:] - end[:-1] <= self.keep_ms
        before = np.zeros(n + rows, np.int64)
        before[1:] = np.where(follows[1:], rank[:-1], 0)
        up = batch.iloc[at[fresh[at] & (rank >= 1) & (rank > before)] - n]
        last = np.ones(n + rows, bool)
        last[:-1] = (call[1:] != call[:-1]) | (none[1:] != none[:-1])
        held = dict(zip(self.HELD, (x[last] for x in (none, call, rank, end, due)), strict=True))
        name = pd.arrays.IntegerArray(up["call"].to_numpy(np.int64), up["none"].to_numpy(bool))
        return held, up.assign(call_id=name)[ALERT_COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        calls, due = self._held()
        if due is not None:
            self._hold(calls, due, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


ALERT = "call_id bigint, window_start timestamp, window_end timestamp, risk_level string, risk_score double, fraud_type string"
ALERT_COLUMNS = ["call_id", "window_start", "window_end", "risk_level", "risk_score", "fraud_type"]


#: Groups of the alert state, each of the calls of one hash. They are the keys of the state, so their number stays
#: what it is while a checkpoint is in use.
CALL_BUCKETS = 1024


def rise_alerts(scored: DataFrame, keep_ms: int = KEEP_MS, most: int = 100_000, buckets: int = CALL_BUCKETS) -> DataFrame:
    """Alerts of a stream of scored windows, by the same rule as `operators.alerts.rises`.

    A call that says nothing for `keep_ms` of event time has ended. Its next window follows
    a low one by that rule, so clearing its state then changes no result; the state holds
    live calls only, those of a bucket in one value.
    """
    call = F.col("call_id")
    return (
        scored.select(
            F.pmod(F.xxhash64(call), F.lit(buckets)).cast("int").alias("bucket"), call.isNull().alias("none"), F.coalesce(call, F.lit(0)).alias("call"),
            *ALERT_COLUMNS[1:], F.unix_millis("window_start").alias("start_ms"), F.unix_millis("window_end").alias("end_ms"),
        )
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=RiseAlert(keep_ms, most), outputStructType=ALERT, outputMode="Append", timeMode="EventTime"
        )
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Process all that is available and append it to a Parquet table; returns when done.

    The checkpoint lets a restarted query go on where it stopped, without repeats.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def score_stream(
    windows: DataFrame, cases: DataFrame, path: str, checkpoint: str, columns: list[str] = ALERT_COLUMNS, topk: TopKOptions = TopKOptions()
) -> DataFrame:
    """Score a stream of windows against a case table of any size into a table at `path`.

    Every micro-batch is a table of its own and takes the same route as a batch. It is stored
    whole or not at all, and a repeated one is not stored again. Returns the table.
    """
    return _scored_batches(windows, cases, path, checkpoint, columns, topk).read()


def _scored_batches(windows: DataFrame, cases: DataFrame, path: str, checkpoint: str, columns: list[str], topk: TopKOptions) -> BatchTable:
    spark = windows.sparkSession
    shape = score_windows(spark.createDataFrame([], windows.schema), cases, topk=topk).select(*columns).schema
    table = BatchTable(spark, path, shape)

    def write(batch: DataFrame, number: int) -> None:
        table.add_streamed(number, batch, lambda df: score_windows(df, cases, topk=topk))

    _run(windows.writeStream.foreachBatch(write), checkpoint)
    return table


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def alert_stream(windows: DataFrame, cases: DataFrame, path: str, topk: TopKOptions = TopKOptions(), keep_ms: int = KEEP_MS) -> DataFrame:
    """Rise alerts of a stream of windows, against a case table of any size; returns their table.

    Two queries follow each other. The first scores micro-batches as tables into numbered batches; a call's
    windows close in the order of their ends, so batches are in the order of time. The second streams those
    batches, each one whole, through the state that holds the last level of each call. Both have their
    checkpoints under `path`, so calling this again goes on where it stopped and repeats nothing. A case table
    within the resident bound could be scored inside one query (`score_windows`, `rise_alerts`) with the same
    alerts.
    """
    scored = _scored_batches(windows, cases, f"{path}/scored", f"{path}/scored-checkpoint", ALERT_COLUMNS, topk)
    shape = T.StructType.fromDDL(ALERT)
    found = BatchTable(windows.sparkSession, f"{path}/alerts", shape)
    rising = rise_alerts(scored.stream().withWatermark("window_end", "0 seconds"), keep_ms)
    _run(rising.writeStream.outputMode("append").foreachBatch(lambda batch, number: found.add_streamed(number, batch) and None), f"{path}/alerts-checkpoint")
    return found.read()
