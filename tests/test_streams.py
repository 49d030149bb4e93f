"""Streams whose state lives over several runs: leases, seats, the cache as de-duplication; and numbering by ranges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.functions.ranks import numbered_in_order
from foliant.operators import licence
from foliant.streaming import streams

DAY, BEGIN = 86_400, 1_700_000_000


def run(spark, folder, n, rows, schema, follow):
    """One more run of a stream over one more file; the rows that come out."""
    df = spark.createDataFrame(rows, f"{schema}, day double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("day") * DAY + BEGIN)).drop("day")
    if "expires" in df.columns:
        df = df.withColumn("expires", F.timestamp_seconds(F.col("expires") * DAY + BEGIN))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream, out = spark.readStream.schema(df.schema).parquet(f"{folder}/in"), []
    with streams.with_state_store(spark):
        q = follow(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def held(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state").count()


LEASE = "event_id long, user_id long, what string, offline boolean, status string, expires double"


def lease_rows(*events):
    return [(i, who, what, offline, status, expires, float(day)) for i, (who, what, day, offline, status, expires) in enumerate(events)]


def test_lease_probes(spark, tmp_path):
    """A revoked lease is not renewed by a refresh; past its grace a check says expired; a deactivated machine stays out."""
    plain = (False, "active", None)
    rows = lease_rows(
        (1, "activate", 0, *plain), (1, "revoke", 1, *plain), (1, "refresh", 2, *plain), (1, "check", 3, *plain), (1, "check", 8, *plain), (1, "check", 40, *plain),
        (2, "activate", 0, *plain), (2, "revoke", 1, *plain), (2, "activate", 2, *plain), (2, "refresh", 6, *plain), (2, "check", 12, *plain), (2, "check", 14, True, "active", None),
        (3, "activate", 0, *plain), (3, "deactivate", 1, *plain), (3, "activate", 9, *plain), (3, "check", 10, *plain), (3, "check", 10, True, "active", None),
        (4, "refresh", 0, *plain), (4, "check", 1, *plain), (4, "activate", 2, False, "suspended", None), (4, "check", 3, *plain),
        (5, "activate", 0, False, "active", 4.0), (5, "check", 3, False, "active", 4.0), (5, "check", 5, False, "active", 4.0), (5, "check", 5, False, "active", 9.0), (5, "check", 6, False, "revoked", 9.0),
        (6, "check", 40, *plain), (7, "activate", 0, *plain), (7, "check", 0, *plain), (7, "check", 30, True, "active", None),
    )
    got = run(spark, tmp_path, 0, rows, LEASE, streams.lease_status)
    told = [r.token_state for who in range(1, 8) for r in sorted(got, key=lambda r: r.event_id) if r.user_id == who]
    assert told == ["active", "revoked", "expired", "refresh_due", "grace", "deactivated", "grace", "none", "none", "active", "expired", "refresh_due", "revoked", "none", "active", "expired"]


def test_lease_state(spark, tmp_path):
    """Over several runs, with the token gone and the machine's standing kept."""
    parts = [
        [(0, 1, "activate", False, "active", None, 0.0), (1, 1, "deactivate", False, "active", None, 1.0), (2, 2, "activate", False, "active", None, 0.0), (3, 2, "revoke", False, "active", None, 1.0)],
        [(4, 9, "activate", False, "active", None, 60.0)],
        [(5, 9, "check", False, "active", None, 61.0), (6, 1, "activate", False, "active", None, 61.0), (7, 2, "refresh", False, "active", None, 61.0), (8, 1, "check", False, "active", None, 61.5), (9, 2, "check", True, "active", None, 61.5), (10, 3, "check", True, "active", None, 61.5)],
        [(11, 2, "activate", False, "active", None, 62.0), (12, 2, "check", False, "active", None, 63.0), (13, 1, "check", True, "active", None, 63.0)],
    ]
    told, tokens = {}, []
    for n, rows in enumerate(parts):
        told |= {r.event_id: r.token_state for r in run(spark, tmp_path, n, rows, LEASE, streams.lease_status)}
        tokens.append(held(spark, tmp_path, "token"))
    assert told == {5: "active", 8: "expired", 9: "expired", 10: "none", 12: "active", 13: "expired"}
    assert tokens[0] == 2 and tokens[2] == 1 and tokens[3] == 2 and held(spark, tmp_path, "standing") == 3


SEATS = "event_id long, machine long, off boolean, licence_id long, max_seats int, status string, expires double"
STEPS = [
    [(0, 10, False, 0), (1, 11, False, 0.1), (2, 12, False, 0.2), (3, 10, True, 0.3), (4, 12, False, 0.4), (5, 10, False, 0.5), (6, 11, False, 0.6), (7, 13, False, 0.7)],
    [(8, 12, True, 90), (9, 14, True, 90.1)],
    [(10, 10, False, 100), (11, 13, False, 100.1), (12, 14, False, 100.2), (13, 12, False, 100.3), (14, 15, False, 100.4)],
]
DECIDED = ["activate", "activate", "refused", "deactivate", "activate", "deactivated", "reactivate", "refused", "deactivate", "deactivate", "deactivated", "activate", "deactivated", "deactivated", "refused"]


def test_seats_over_a_renewal(spark, tmp_path):
    """A deactivation frees a seat and outlives the licence's expiry; the batch form decides alike."""
    decided = {}
    for n, rows in enumerate(STEPS):
        full = [(i, m, off, 1, 2, "active", 30.0 if n == 0 else 900.0, float(day)) for i, m, off, day in rows]
        decided |= {r.event_id: r.decision for r in run(spark, tmp_path, n, full, SEATS, streams.seat_admission)}
    assert [decided[i] for i in range(15)] == DECIDED
    rows = spark.createDataFrame([(i, m, off, 1, float(day)) for part in STEPS for i, m, off, day in part], "event_id long, machine long, off boolean, licence_id long, day double")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("day") * DAY + BEGIN).cast("timestamp_ntz"))
    licences = spark.createDataFrame([(1, 2, "active", None)], "licence_id long, max_seats int, status string, expires timestamp_ntz")
    got = licence.seat_admission(rows.where("not off"), licences, rows.where("off"))
    assert [r.decision for r in got.orderBy("event_id").collect()] == DECIDED


def test_seats_without_licence_or_machine(spark):
    rows = spark.createDataFrame([(0, None, 5), (1, 2, 5), (2, 1, None), (3, 1, 5)], "event_id long, licence_id long, machine long").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    licences = spark.createDataFrame([(1, 1, "active", datetime(2023, 12, 31))], "licence_id long, max_seats int, status string, expires timestamp_ntz")
    got = licence.seat_admission(rows, licences, rows.limit(0)).orderBy("event_id").collect()
    assert [r.decision for r in got] == ["unknown", "unknown", "unknown", "expired"]


def test_snapshots(spark, tmp_path):
    """A first save counts whatever its length, a row behind the watermark while its interval is open, and nothing of a user that is forgotten; F12."""
    schema, hour, out = "event_id long, user_id long, n_bytes long", 1 / 24, []
    begin = BEGIN // 7200 * 2 - BEGIN / 3600  # an interval's start, in hours
    rows = [[(0, 1, -1, 0.0), (1, 1, 7, 2.5), (2, 2, 5, 4.5)], [(3, 2, 6, 3.8), (4, 2, 6, 3.2), (5, 3, 1, 8.5)], [(6, 1, 7, 70 * 24.0), (7, 3, 1, 70 * 24.0), (8, 4, 0, 75 * 24.0)], [(9, 4, 0, 80 * 24.0)]]
    for n, part in enumerate(rows):
        out.append(sorted((r.user_id, (r.slot / 3.6e9 - BEGIN / 3600 - begin), r.n_bytes) for r in run(spark, tmp_path, n, [(i, u, k, (h + begin) * hour) for i, u, k, h in part], schema, streams.autosave_snapshots)))
    flat = [(u, round(h), n) for part in out for u, h, n in part]
    assert flat[:4] == [(1, 0, -1), (1, 2, 7), (2, 2, 6), (2, 4, 5)]
    assert sorted(flat[4:]) == [(1, 1680, 7), (3, 8, 1), (3, 1680, 1), (4, 1800, 0)]
    assert held(spark, tmp_path, "last") == 3


def test_repeats_within_time(spark, tmp_path):
    """One row of a key while its state lives, and the state goes with the watermark."""
    schema, out, left = "event_id long, user_id long", [], []
    for n, rows in enumerate([[(0, 1, 0.0), (1, 1, 0.5), (2, 2, 0.5)], [(3, 1, 1.5), (4, 3, 2.0)], [(5, 4, 9.0)], [(6, 1, 9.5), (7, 2, 9.5), (8, 1, 9.6)]]):
        out.append(sorted(r.user_id for r in run(spark, tmp_path, n, rows, schema, lambda s: streams.first_in_time(s, ["user_id"], "2 days"))))
        left.append(spark.read.format("statestore").load(f"{tmp_path}/state").count())
    assert out == [[1, 2], [3], [4], [1, 2]] and left[2] <= 2


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_by_ranges(spark, parts):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id").repartition(parts).withColumn("v", F.when(F.col("v") > 3, F.col("v")))
    got = numbered_in_order(rows, [F.col("v").asc_nulls_last(), F.col("id").asc()], "place")
    ordered = [tuple(r) for r in got.orderBy("place").collect()]
    assert [p for *_, p in ordered] == list(range(1000))
    assert [(v, i) for v, i, _ in ordered] == sorted(((v, i) for v, i, _ in ordered), key=lambda x: (x[0] is None, x))
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert numbered_in_order(rows.limit(0), [F.col("v"), F.col("id")], "place").count() == 0
