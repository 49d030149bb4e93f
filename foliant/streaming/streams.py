"""Structured Streaming operators over arrival events ``(event_id, ts, user_id, event_type, value, props)``.

Late rows: a watermark of one hour on ``ts``. Windows and sessions come out
once, when the watermark has passed their end; keyed state goes by event-time
timers when nothing can depend on it any more. The snapshots, the cache, the
leases and the seats keep state variables; these need the RocksDB state store
(``with_state_store``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.folders import removed, shared_folder
from ..operators.find import fold_text
from ..operators.licence import Seats

LATE = "1 hour"
DAY = 86_400_000


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream; ``ts`` gets a time zone, which watermarks need.

    The stream source takes folders and patterns, so a table that is one file is named by a pattern.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}").withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state variables and timers need."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_available(stream: DataFrame, mode: str, keys: tuple[str, ...] = (), each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there, into files in the shared folder, and read the result.

    ``each`` is applied to every micro-batch of results. In update mode ``keys``
    tell which rows replace each other: the newest batch's stands.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"

    def write(batch: DataFrame, n: int) -> None:
        done = each(batch) if each else batch
        done.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")

    with with_state_store(spark):
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    removed(spark, f"{folder}/state")  # this run is over; a lasting stream keeps it
    rows = spark.read.parquet(f"{folder}/out")
    if keys:
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
        rows = rows.withColumn("_k", newest).where("_k = 1").drop("_k")
    return rows.drop("_batch")


def debounce_batches(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Arrivals of a user in batches, each out once when nothing has come for the gap: ``(user_id, first_ts, arrivals, kinds, files)``."""
    s = F.session_window("ts", gap)
    files = F.collect_list(F.struct(F.col("event_id").alias("seq"), "path")).alias("files")
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")
    return events.withWatermark("ts", LATE).groupBy("user_id", s.alias("w")).agg(F.count("*").alias("arrivals"), kinds, files).select("user_id", F.col("w.start").alias("first_ts"), "arrivals", "kinds", "files")


def plan_closed(batches: DataFrame) -> DataFrame:
    """The plan of each closed batch: ``(user_id, first_ts, place, path, dropped)``; for the results of one micro-batch."""
    named = batches.withColumn("batch_id", F.struct("user_id", "first_ts")).select("batch_id", F.inline("files"))
    return batch_plan(named).select("batch_id.user_id", "batch_id.first_ts", "place", "path", "dropped")


def _micros(ts: pd.Timestamp) -> int:
    return (ts.tz_localize("UTC") if ts.tzinfo is None else ts).value // 1000


def _in_time(frames: Iterator[pd.DataFrame], *before: str) -> pd.DataFrame:
    rows = pd.concat(list(frames))
    return rows.assign(us=[_micros(t) for t in rows["ts"]]).sort_values(["us", *before, "event_id"], kind="stable")


def latest_wins(events: DataFrame) -> DataFrame:
    """The result of each user's newest generation, for update mode."""
    return events.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


def audit_stream(events: DataFrame) -> DataFrame:
    """An audit row for each event, appended: who, what, which, and the detail of its JSON."""
    return events.select("event_id", "ts", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("detail"))


def audit_daily(events: DataFrame) -> DataFrame:
    """Audit rows per kind and day, out once the day is over."""
    return events.withWatermark("ts", LATE).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("day"), "n", "total")


class _Processor(StatefulProcessor):
    """A state handler that keeps nothing between calls but its state."""

    def close(self) -> None:
        pass


def _told(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows as a frame of plain objects, which Spark can put together with those of other keys; none for no rows."""
    if rows:
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def _follow(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.withWatermark("ts", LATE).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


class _Snapshots(_Processor):
    """A user's last interval that was closed, and the length of its save; the timer drops them once they are forgotten."""

    def __init__(self, width: int, forget: int):
        self.width, self.forget = width, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "slot long, n_bytes long")

    def _ends(self, slot: int) -> int:
        """When every interval that begins within ``forget`` is closed, in milliseconds."""
        return (slot + self.forget + self.width) // 1000

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.last.get()
        last, saved = held or (None, None)
        for slot, n in sorted(((r.slot, r.n_bytes) for r in rows), key=lambda x: x[0]):
            if last is not None and slot - last >= self.forget:
                saved = None
            if n != saved:
                yield Row(user_id=key[0], slot=slot, n_bytes=n)
            last, saved = slot, n
        ends = self._ends(last)
        if ends > timerValues.getCurrentWatermarkInMs():
            self.last.update((last, saved))
            self.handle.registerTimer(ends)
        else:  # it is forgotten already
            self.last.clear()

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held and self._ends(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()  # else there was a save since the timer was set
        return iter(())


def autosave_snapshots(saves: DataFrame, every: timedelta = timedelta(hours=2), forget: timedelta = timedelta(days=60)) -> DataFrame:
    """The last save of each user in each interval, out once the interval is over: ``(user_id, slot, n_bytes)``.

    ``saves (event_id, ts, user_id, n_bytes)``. One of the length of the last
    snapshot is skipped; a user without saves for ``forget`` starts anew.
    ``slot`` is the interval's start in microseconds.

    The last save of an interval is a windowed aggregate, so that only closed
    intervals, each once and without its time stamp, come to the handler.
    """
    us = timedelta(microseconds=1)
    kept = saves.withWatermark("ts", LATE).groupBy("user_id", F.window("ts", f"{every // us} microseconds").alias("w"))
    closed = kept.agg(F.max_by("n_bytes", F.when(F.col("n_bytes").isNotNull(), F.struct("ts", "event_id"))).alias("n_bytes")).select("user_id", F.unix_micros("w.start").alias("slot"), "n_bytes")
    return closed.groupBy("user_id").transformWithState(_Snapshots(every // us, forget // us), "user_id long, slot long, n_bytes long", "append", "eventTime")


class _Cache(_Processor):
    """When a key's entry was stored; the timer drops it once it has run out."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.stored = handle, handle.getValueState("stored", "us long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = stored = self.stored.get()[0] if self.stored.exists() else None
        out = []
        for e in _in_time(rows).itertuples():
            hit = stored is not None and e.us - stored <= self.life
            stored = stored if hit else e.us
            out.append((e.event_id, key[0], hit))
        if stored != before:
            ends = (stored + self.life) // 1000 + 1
            if ends > timerValues.getCurrentWatermarkInMs():
                self.stored.update((stored,))
                self.handle.registerTimer(ends)
            else:  # it has run out already
                self.stored.clear()
        yield from _told(out, ["event_id", "user_id", "hit"])

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.stored.exists() and (self.stored.get()[0] + self.life) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.stored.clear()  # else it was stored anew since the timer was set
        return iter(())


def ttl_cache(events: DataFrame, ttl: timedelta = timedelta(days=3)) -> DataFrame:
    """Hits and misses per key: an entry lives for ``ttl`` from when it was stored, then goes; hits do not prolong it."""
    kept = events.select("event_id", "ts", "user_id")
    return _follow(kept, "user_id", _Cache(ttl // timedelta(microseconds=1)), "event_id long, user_id long, hit boolean")


def first_in_time(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """One row of each key within the watermark's delay; a key's state goes when the watermark has passed its first row by that much.

    This is the cache where only de-duplication is asked for. A row comes out
    again if its key comes back later than that, so ``late`` is the time to live.
    """
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class _Lease(_Processor):
    """A token, dropped by its timer when lease and grace are over, and the standing of its machine, which lives on."""

    def __init__(self, lease: int, due: int, grace: int):
        self.lease, self.due, self.grace = lease, due, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.token = handle.getValueState("token", "granted long")
        self.standing = handle.getValueState("standing", "revoked boolean, deactivated boolean")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.standing.exists()
        standing = revoked, off = self.standing.get() if known else (False, False)
        before = granted = self.token.get()[0] if self.token.exists() else None
        out = []
        for e in _in_time(rows, "check").itertuples():
            expired = not pd.isna(e.expires) and _micros(e.expires) < e.us
            fine = not expired and (pd.isna(e.status) or e.status == "active")
            if e.what == "activate" and fine and not off:
                known, revoked, granted = True, False, e.us
            elif e.what == "refresh" and fine and known and not off and not revoked:
                granted = e.us
            elif e.what == "revoke":
                revoked = known
            elif e.what == "deactivate":
                off = known
            elif e.what == "check":
                days = self.lease + self.grace if granted is None else (e.us - granted) / (DAY * 1000)
                if not known:
                    told = "none"
                elif expired:
                    told = "expired"
                elif not fine:
                    told = e.status
                elif days < self.lease:
                    told = "active" if days < self.lease - self.due else "refresh_due"
                elif days >= self.lease + self.grace:
                    told = "expired"
                else:
                    told = "grace" if e.offline else "deactivated" if off else "revoked" if revoked else "expired"
                out.append((e.event_id, key[0], told))
        if known and (standing != (revoked, off) or not self.standing.exists()):
            self.standing.update((revoked, off))
        if granted != before:
            ends = granted // 1000 + (self.lease + self.grace) * DAY
            if ends > timerValues.getCurrentWatermarkInMs():
                self.token.update((granted,))
                self.handle.registerTimer(ends)
            else:
                self.token.clear()
        yield from _told(out, ["event_id", "user_id", "token_state"])

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.token.exists() and self.token.get()[0] // 1000 + (self.lease + self.grace) * DAY <= expiredTimerInfo.getExpiryTimeInMs():
            self.token.clear()  # else it was renewed since the timer was set
        return iter(())


def lease_status(events: DataFrame, lease: int = 7, due: int = 2, grace: int = 14) -> DataFrame:
    """The token's state at each check: ``events (event_id, ts, user_id, what, offline, status, expires)``.

    ``what`` is activate, refresh, revoke, deactivate or check; ``status`` and
    ``expires`` are the licence's at that time (null: no limit). An activation
    or a refresh counts only under an active licence that has not expired. A
    refresh needs an activation before it and renews neither a revoked token
    nor one of a deactivated machine; an activation lifts a revocation, but a
    deactivated machine stays out, after any pause.

    A check of a machine that was never activated is ``none``. Past the
    licence's expiry it is ``expired``, under a status that is not active that
    status. Within the lease, in days, a token is ``active``, in its last days
    ``refresh_due``: a revocation tells at the next refresh only. Behind the
    lease an offline check has ``grace``, any other is ``deactivated``,
    ``revoked`` or ``expired``; past the grace all are ``expired``. Then a timer
    drops the token; two bits of a machine's standing stay.
    """
    kept = events.select("event_id", "ts", "user_id", "what", "offline", "status", "expires", (F.col("what") == "check").alias("check"))
    return _follow(kept, "user_id", _Lease(lease, due, grace), "event_id long, user_id long, token_state string")


class _Seats(_Processor):
    """A licence's machines, on or off, and how many are on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machines = handle.getMapState("machines", "machine long", "active boolean")
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        asked = _in_time(rows)
        known = {}
        for m in asked["machine"].unique().tolist():  # only those that the rows name are read
            held = self.machines.getValue((m,))
            known[m] = None if held is None else held[0]
        book = Seats(dict(known), self.taken.get()[0] if self.taken.exists() else 0)
        ends = [None if pd.isna(t) else _micros(t) for t in asked["expires"]]
        out = [(e.event_id, key[0], e.machine, book.decide(e.machine, e.off, e.max_seats, e.status, end, e.us)) for e, end in zip(asked.itertuples(), ends, strict=True)]
        for m, active in book.machines.items():
            if active is not None and active != known[m]:
                self.machines.updateValue((m,), (active,))
        self.taken.update((book.taken,))
        yield from _told(out, ["event_id", "licence_id", "machine", "decision"])


def seat_admission(requests: DataFrame) -> DataFrame:
    """Decisions on ``(event_id, ts, licence_id, machine, max_seats, off, status, expires)``, by the rules of ``licence.Seats``.

    The state is the table of activations: machines stay in it, on or off,
    beyond a licence's expiry, so a deactivated one stays refused and an
    active one keeps its seat when the licence is renewed. It grows with the
    machines that were ever admitted or deactivated, not with the requests.
    Rows without a machine are no requests.
    """
    kept = requests.where("machine is not null").select("event_id", "ts", "licence_id", "machine", "max_seats", "off", "status", "expires")
    return _follow(kept, "licence_id", _Seats(), "event_id long, licence_id long, machine long, decision string")


def batch_plan(paths: DataFrame, most: int = 60, ending: str = ".pdf") -> DataFrame:
    """Order of the files of each batch ``(batch_id, seq, path)``: one per normalised path, by natural name order, at most ``most``.

    The cap is the feature; ``dropped`` tells how many files it left out.
    """
    norm = F.lower(F.translate("path", "\\", "/"))
    own = paths.where(F.endswith(F.lower("path"), F.lit(ending))).withColumn("_n", norm)
    first = own.groupBy("batch_id", "_n").agg(F.min_by("path", "seq").alias("path"))
    name = fold_text(F.element_at(F.split("_n", "/"), -1))
    natural = F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 20, "0")).otherwise(x)), "")
    batch = Window.partitionBy("batch_id")
    ranked = first.withColumn("_k", F.row_number().over(batch.orderBy(natural, "path"))).withColumn("_all", F.count("*").over(batch))
    return ranked.where(F.col("_k") <= most).select("batch_id", (F.col("_k") - 1).alias("place"), "path", F.greatest(F.col("_all") - most, F.lit(0)).alias("dropped"))
