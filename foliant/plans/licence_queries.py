"""Queries over licences, leases, audit rows and note threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import licence
from ..sources.corpus import table


def _licences(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("plan"),
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("note"),
        (1 + F.col("c_custkey") % 5 * 3).alias("max_seats"),
        F.when(F.col("c_acctbal") < 0, "suspended").otherwise("active").alias("status"),
        F.when(F.col("c_custkey") % 4 != 0, F.date_add(F.lit("2023-10-01").cast("date"), (F.col("c_custkey") % 200).cast("int")).cast("timestamp")).alias("expires"),
        F.date_add(F.lit("2023-06-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("timestamp").alias("issued"),
    )


def license_search(spark, d):
    found = licence.license_search(_licences(spark, d), query="1", seats="3-10", issued_days=120, state="active")
    return found.select("id", "name", "plan", "max_seats", "state", "position")


def license_search_newest(spark, d):
    """All expired or suspended licences, those without an expiry first, then the latest expiry."""
    found = licence.license_search(_licences(spark, d), issued_days=None, seats="3-10", sort="expires", ascending=False)
    return found.where("state <> 'active'").select("id", "state", "position")


def license_overview(spark, d):
    licences = table(spark, d, "customer").select(F.col("c_custkey").alias("licence_id"), (1 + F.col("c_custkey") % 5).alias("max_seats"))
    acts = table(spark, d, "orders").select(F.col("o_custkey").alias("licence_id"), (F.col("o_orderstatus") == "O").alias("active"))
    return licence.license_overview(licences, acts)


def admin_gate(spark, d):
    allowed = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return licence.admin_gate(table(spark, d, "events"), allowed, "user_id").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("actors"))


def token_status(spark, d):
    e = table(spark, d, "events")
    grants = e.where("event_type in ('signup', 'purchase') and event_id % 30 = 0").select(F.col("user_id").alias("key"), "ts")
    checks = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("check_id"), (F.col("event_id") % 2 == 0).alias("offline"))
    k = F.col("key")
    status = F.when(k % 11 == 0, "suspended").when(k % 13 == 0, "revoked").otherwise("active")
    expires = F.when(k % 4 == 0, F.expr("timestamp_ntz'2024-01-10 00:00:00'") + F.make_dt_interval((k % 15).cast("int")))
    licences = e.select(F.col("user_id").alias("key")).distinct().select("key", status.alias("status"), expires.alias("expires"))
    return licence.token_status(grants, checks, licences).select("key", "check_id", micros("ts").alias("ts_us"), micros("granted").alias("granted_us"), "token_state")


def audit_tail(spark, d):
    return licence.audit_tail(table(spark, d, "events")).withColumn("ts", micros("ts"))


def comments_panel(spark, d):
    return licence.comments_panel(table(spark, d, "conversations"))


def thread_flatten(spark, d):
    return licence.thread_flatten(table(spark, d, "conversations"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), (F.floor(F.col("o_totalprice") / 100000) * 10_000_000).cast("long").alias("n_bytes"))


def history_trim(spark, d):
    """Within the feature's own limits: 30 versions, 512 MB."""
    return licence.history_trim(_versions(spark, d), 30, 512 * 1024 * 1024)


def unchanged_snapshot_skip(spark, d):
    return licence.unchanged_snapshot_skip(_versions(spark, d))


def _seats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Requests for seats, and errors that deactivate their machine."""
    e = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 40).alias("licence_id"), F.col("user_id").alias("machine"), "event_type")
    return e.where("event_type = 'signup'"), e.where("event_type = 'error' and event_id % 5 = 0")


def seat_admission(spark, d):
    requests, off = _seats(spark, d)
    k = F.col("licence_id")
    expires = F.when(k % 9 == 2, F.expr("timestamp_ntz'2024-01-12 00:00:00'"))
    licences = requests.where(k != 39).select("licence_id").distinct().select("licence_id", (1 + k % 3).alias("max_seats"), F.when(k % 8 == 1, "suspended").otherwise("active").alias("status"), expires.alias("expires"))
    return licence.seat_admission(requests, licences, off)


def seat_admission_open(spark, d):
    """Active licences without an expiry, nobody deactivated."""
    requests, _ = _seats(spark, d)
    licences = requests.select("licence_id").distinct().select("licence_id", (1 + F.col("licence_id") % 3).alias("max_seats"), F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("expires"))
    return licence.seat_admission(requests, licences, requests.limit(0))


_V = "SELECT o_custkey AS doc_id, o_orderkey AS seq, CAST(floor(o_totalprice / 100000) * 10000000 AS BIGINT) AS n_bytes FROM orders"
_LICENCES = """l AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS plan, 'nation ' || c_nationkey AS note, 1 + c_custkey % 5 * 3 AS max_seats,
          CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status,
          CASE WHEN c_custkey % 4 <> 0 THEN DATE '2023-10-01' + CAST(c_custkey % 200 AS INTEGER) END AS expires,
          DATE '2023-06-01' + CAST(c_custkey % 300 AS INTEGER) AS issued FROM customer),
        s AS (SELECT *, CASE WHEN expires < DATE '2024-01-01' THEN 'expired' ELSE status END AS state FROM l)"""
_OPEN = """WITH e AS (SELECT event_id, ts, user_id % 40 AS licence_id, user_id AS machine FROM events WHERE event_type = 'signup'),
        f AS (SELECT licence_id, machine, min((ts, event_id)) AS f, arg_min(event_id, (ts, event_id)) AS first_id FROM e GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY licence_id ORDER BY f, machine) AS seat FROM f)
        SELECT event_id, licence_id, machine, CASE WHEN seat > 1 + licence_id % 3 THEN 'refused' WHEN first_id = event_id THEN 'activate' ELSE 'reactivate' END AS decision
        FROM e JOIN r USING (licence_id, machine)"""
#: Each licence's rows one after the other, with the lists of machines that are on and off.
SEATS = """WITH RECURSIVE e AS (SELECT event_id, ts, user_id % 40 AS licence_id, user_id AS machine, event_type = 'error' AS off FROM events WHERE event_type = 'signup' OR event_type = 'error' AND event_id % 5 = 0),
        r AS (SELECT *, 1 + licence_id % 3 AS most, CASE WHEN licence_id = 39 THEN 'unknown' WHEN licence_id % 8 = 1 THEN 'suspended' WHEN licence_id % 9 = 2 AND ts > TIMESTAMP '2024-01-12' THEN 'expired' END AS barred,
          row_number() OVER (PARTITION BY licence_id ORDER BY ts, event_id) AS n FROM e),
        s AS (SELECT DISTINCT licence_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ons, CAST([] AS BIGINT[]) AS offs, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS machine, CAST(NULL AS VARCHAR) AS decision FROM e
          UNION ALL SELECT licence_id, n, CASE decision WHEN 'deactivate' THEN [x FOR x IN ons IF x <> machine] WHEN 'activate' THEN list_append(ons, machine) ELSE ons END,
            CASE WHEN decision = 'deactivate' THEN list_append(offs, machine) ELSE offs END, event_id, machine, decision
          FROM (SELECT r.licence_id, r.n, s.ons, s.offs, r.event_id, r.machine, CASE WHEN r.off THEN 'deactivate' WHEN r.barred IS NOT NULL THEN r.barred WHEN list_contains(s.offs, r.machine) THEN 'deactivated'
              WHEN list_contains(s.ons, r.machine) THEN 'reactivate' WHEN len(s.ons) >= r.most THEN 'refused' ELSE 'activate' END AS decision
            FROM s JOIN r ON r.licence_id = s.licence_id AND r.n = s.n + 1))
        SELECT event_id, licence_id, machine, decision FROM s WHERE n > 0"""
QUERIES = {
    "license_search": (
        license_search,
        f"""WITH {_LICENCES} SELECT id, name, plan, max_seats, state, row_number() OVER (ORDER BY expires NULLS LAST, id) - 1 AS position FROM s WHERE state = 'active' AND max_seats BETWEEN 3 AND 10 AND DATE '2024-01-01' - issued <= 120
          AND (contains(lower(name), '1') OR contains(lower(plan), '1') OR contains(note, '1') OR contains(CAST(id AS VARCHAR), '1'))""",
    ),
    "license_search_newest": (
        license_search_newest,
        f"WITH {_LICENCES} SELECT id, state, position FROM (SELECT *, row_number() OVER (ORDER BY expires DESC NULLS FIRST, id) - 1 AS position FROM s WHERE max_seats BETWEEN 3 AND 10) WHERE state <> 'active'",
    ),
    "license_overview": (
        license_overview,
        """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
        SELECT c_custkey AS licence_id, 1 + c_custkey % 5 AS max_seats, coalesce(n, 0) AS active_seats, 1 + c_custkey % 5 - coalesce(n, 0) AS free_seats
        FROM customer LEFT JOIN a ON o_custkey = c_custkey""",
    ),
    "admin_gate": (
        admin_gate,
        """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS actors FROM events
        WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY event_type""",
    ),
    "token_status": (
        token_status,
        """WITH g AS (SELECT user_id AS key, ts AS granted FROM events WHERE event_type IN ('signup', 'purchase') AND event_id % 30 = 0),
        c AS (SELECT user_id AS key, event_id AS check_id, ts, (SELECT max(granted) FROM g WHERE g.key = events.user_id AND granted <= ts) AS granted FROM events WHERE event_type = 'view'),
        a AS (SELECT *, (epoch_us(ts) - epoch_us(granted)) / 86400000000 AS days FROM c)
        SELECT key, check_id, epoch_us(ts) AS ts_us, epoch_us(granted) AS granted_us, CASE WHEN granted IS NULL THEN 'none'
        WHEN key % 4 = 0 AND TIMESTAMP '2024-01-10' + to_days(CAST(key % 15 AS INTEGER)) < ts THEN 'expired' WHEN key % 11 = 0 THEN 'suspended' WHEN key % 13 = 0 THEN 'revoked' WHEN days < 5 THEN 'active'
        WHEN days < 7 THEN 'refresh_due' WHEN check_id % 2 = 0 AND days < 21 THEN 'grace' ELSE 'expired' END AS token_state FROM a""",
    ),
    "audit_tail": (audit_tail, "SELECT event_id, epoch_us(ts) AS ts, event_type, json_extract_string(props, '$.k') AS detail FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 200"),
    "comments_panel": (comments_panel, "SELECT conv_id, arg_min(text, turn) AS note, count(*) - 1 AS replies FROM conversations GROUP BY conv_id HAVING regexp_matches(arg_min(text, turn), '[^[:space:]]')"),
    "thread_flatten": (thread_flatten, "SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN text ELSE chr(10) || chr(10) || '— [' || turn || '] ' || text END, '' ORDER BY turn) AS flat FROM conversations GROUP BY conv_id"),
    "history_trim": (
        history_trim,
        f"""WITH v AS ({_V}), r AS (SELECT *, row_number() OVER w AS k, sum(n_bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY seq DESC))
        SELECT doc_id, seq, n_bytes FROM r WHERE k = 1 OR (k <= 30 AND s <= 536870912)""",
    ),
    "unchanged_snapshot_skip": (
        unchanged_snapshot_skip,
        f"WITH v AS ({_V}) SELECT doc_id, seq, n_bytes FROM (SELECT *, lag(n_bytes) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM v) WHERE n_bytes IS DISTINCT FROM b",
    ),
    "seat_admission": (seat_admission, SEATS),
    "seat_admission_open": (seat_admission_open, _OPEN),
}
