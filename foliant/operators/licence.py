"""Licences, seats, leases, audit and note threads as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import numbered_in_order
from ..functions.times import micros

LEASE_DAYS, REFRESH_DUE_DAYS, GRACE_DAYS = 7, 2, 14


def license_search(licences: DataFrame, query: str = "", plan: str | None = None, seats: str | None = None, issued_days: int | None = None, state: str | None = None, now: str = "2024-01-01", columns: tuple[str, ...] = ("name", "plan", "note", "id"), sort: str = "expires", ascending: bool = True) -> DataFrame:
    """Licences that match all given criteria, with ``state`` (expired once past the expiry) and ``position`` in the order.

    The order is by ``sort``, those without a value last (first if descending),
    then by id, which tells rows apart.
    """
    today = F.to_timestamp(F.lit(now))
    found = licences.withColumn("state", F.when(F.col("expires") < today, "expired").otherwise(F.col("status")))
    if query:
        low = F.lit(query.lower())
        found = found.where(F.greatest(*(F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), low) for c in columns)))
    if plan:
        found = found.where(F.col("plan") == plan)
    if seats:
        n = F.col("max_seats")
        found = found.where({"1-2": n.between(1, 2), "3-10": n.between(3, 10), "11+": n >= 11}[seats])
    if issued_days is not None:
        found = found.where(F.datediff(today, "issued") <= issued_days)
    if state:
        found = found.where(F.col("state") == state)
    value = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_first()
    return numbered_in_order(found, [value, F.col("id").asc()], "position")


def license_overview(licences: DataFrame, activations: DataFrame) -> DataFrame:
    """Seats in use per licence; free seats can be negative."""
    active = activations.where("active").groupBy("licence_id").agg(F.count("*").alias("n"))
    used = F.coalesce("n", F.lit(0))
    return licences.join(active, "licence_id", "left").select("licence_id", "max_seats", used.alias("active_seats"), (F.col("max_seats") - used).alias("free_seats"))


def admin_gate(rows: DataFrame, allowed: DataFrame, actor: str) -> DataFrame:
    """Rows whose actor is on the list."""
    return rows.join(allowed, actor, "left_semi")


def token_status(grants: DataFrame, checks: DataFrame, licences: DataFrame) -> DataFrame:
    """The state of a token at each check: the last grant at or before it, as of its age.

    ``grants (key, ts)``, ``checks (key, ts, check_id, offline)`` and ``licences
    (key, status, expires)``. Without a grant the state is ``none``. Then the
    licence rules: past its expiry it is ``expired``, and a status that is not
    active is the state. Within the lease a token is ``active``, in its last
    days ``refresh_due``; after that an offline check has ``grace`` for a while,
    any other is ``expired``. A key without a licence has no such limits.
    """
    events = grants.select("key", "ts", F.col("ts").alias("granted"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("check_id"))
    asked = checks.select("key", "ts", F.lit(None).cast(grants.schema["ts"].dataType).alias("granted"), F.lit(1).alias("kind"), "check_id", "offline")
    upto = Window.partitionBy("key").orderBy("ts", "kind", "check_id").rowsBetween(Window.unboundedPreceding, 0)
    known = events.unionByName(asked, allowMissingColumns=True).withColumn("granted", F.last("granted", ignorenulls=True).over(upto)).where("kind = 1")
    days = (micros("ts") - micros("granted")) / 86_400_000_000
    state = (
        F.when(F.col("granted").isNull(), "none")
        .when(F.col("expires") < F.col("ts"), "expired")
        .when(F.col("status") != "active", F.col("status"))
        .when(days < LEASE_DAYS - REFRESH_DUE_DAYS, "active")
        .when(days < LEASE_DAYS, "refresh_due")
        .when(F.col("offline") & (days < LEASE_DAYS + GRACE_DAYS), "grace")
        .otherwise("expired")
    )
    return known.join(licences.select("key", "status", "expires"), "key", "left").select("key", "check_id", "ts", "granted", state.alias("token_state"))


def audit_tail(events: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` rows with a field of their JSON detail."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").alias("detail"))


def comments_panel(threads: DataFrame) -> DataFrame:
    """Per thread the note and the number of replies; threads whose note is blank are left out."""
    panel = threads.groupBy("conv_id").agg(F.min_by("text", "turn").alias("note"), (F.count("*") - 1).alias("replies"))
    return panel.where(F.col("note").rlike(r"\S"))


def thread_flatten(threads: DataFrame) -> DataFrame:
    """A thread as one text: the note, then each reply behind its stamp."""
    part = F.struct("turn", F.when(F.col("turn") == 0, F.col("text")).otherwise(F.concat(F.lit("\n\n— ["), F.col("turn").cast("string"), F.lit("] "), F.col("text"))).alias("t"))
    return threads.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("flat"))


def history_trim(versions: DataFrame, depth: int, budget: int) -> DataFrame:
    """The newest versions of each document within the depth and the byte budget, at least one."""
    newest = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
    ranked = versions.withColumn("_k", F.row_number().over(newest)).withColumn("_sum", F.sum("n_bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("_k") == 1) | ((F.col("_k") <= depth) & (F.col("_sum") <= budget))).drop("_k", "_sum")


def unchanged_snapshot_skip(saves: DataFrame) -> DataFrame:
    """Saves whose length differs from the one before; skipped saves have the same length, so comparing neighbours is enough."""
    before = F.lag("n_bytes").over(Window.partitionBy("doc_id").orderBy("seq"))
    return saves.withColumn("_b", before).where(~F.col("n_bytes").eqNullSafe(F.col("_b"))).drop("_b")


@dataclass
class Seats:
    """One licence's machines: whether each is active, and how many are."""

    machines: dict[int, bool | None] = field(default_factory=dict)
    taken: int = 0

    def decide(self, machine: int, off: bool, most: Any, status: Any, ends: float | None, us: int) -> str:
        """What becomes of one row at ``us`` microseconds, under a licence that ``ends`` then.

        A row with ``off`` deactivates its machine, which frees its seat. For a
        request the licence comes first: ``unknown`` without one, its status if
        that is not active, ``expired`` past its expiry. A machine that was
        deactivated stays ``deactivated``, a known one is activated again, and
        a new one is ``refused`` unless a seat is free.
        """
        known = self.machines.get(machine)
        if off:
            self.taken -= known is True
            self.machines[machine] = False
            return "deactivate"
        if pd.isna(status):
            return "unknown"
        if status != "active":
            return status
        if ends is not None and ends < us:  # a missing number is not smaller
            return "expired"
        if known is not None:
            return "reactivate" if known else "deactivated"
        if self.taken >= most:
            return "refused"
        self.machines[machine] = True
        self.taken += 1
        return "activate"


def seat_admission(requests: DataFrame, licences: DataFrame, deactivations: DataFrame) -> DataFrame:
    """Decisions on ``requests (event_id, ts, licence_id, machine)`` and on ``deactivations``, of the same columns, by the rules of ``Seats``.

    ``licences (licence_id, max_seats, status, expires)``. A licence's rows are
    taken in the order of time and id, as a stream that holds no more than its
    machines: each decision rests on all before it. They are numbered in a
    window, which keeps a licence in one task however the join is run. Rows
    without a licence or a machine are ``unknown``.
    """
    columns = ["event_id", "ts", "licence_id", "machine"]
    rows = requests.select(*columns, F.lit(False).alias("off")).unionByName(deactivations.select(*columns, F.lit(True).alias("off")))
    known = rows.join(licences.select("licence_id", "max_seats", "status", "expires"), "licence_id", "left")
    known = known.select("event_id", "licence_id", "machine", "off", "max_seats", "status", micros("expires").alias("ends"), micros("ts").alias("us"))

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Seats()
        for f in frames:
            told = []
            for e in f.itertuples():
                if e.turn == 1:
                    book = Seats()
                told.append(book.decide(e.machine, e.off, e.max_seats, e.status, e.ends, e.us))
            yield f[["event_id", "licence_id", "machine"]].assign(decision=told)

    turn = F.row_number().over(Window.partitionBy("licence_id").orderBy("us", "event_id"))
    ordered = known.where("licence_id is not null and machine is not null").withColumn("turn", turn)
    lost = known.where("licence_id is null or machine is null").select("event_id", "licence_id", "machine", F.lit("unknown").alias("decision"))
    return ordered.mapInPandas(follow, "event_id long, licence_id long, machine long, decision string").unionByName(lost)
