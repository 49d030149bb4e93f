"""Streaming queries, each run over the events that are there; their SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..sources import corpus
from ..streaming import streams as st
from .licence_queries import SEATS


def _events(spark: SparkSession, d: str) -> DataFrame:
    return st.read_events(spark, f"{d}/events.parquet")


def _us(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, micros(F.col(c).cast("timestamp_ntz")))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events as files that drip in, some of them again in another spelling."""
    name = F.concat("event_type", F.lit("/File"), (F.col("event_id") % 40).cast("string"), F.when(F.col("event_id") % 7 == 0, ".txt").otherwise(".pdf"))
    return _events(spark, d).withColumn("path", F.when(F.col("event_id") % 3 == 0, F.upper(name)).otherwise(name))


def debounce_batches(spark, d):
    return _us(st.run_available(st.debounce_batches(_arrivals(spark, d)), "append"), "first_ts").drop("files")


def debounced_plans(spark, d):
    """With a gap of 36 hours, so that batches have many files; the plan is made as each batch closes."""
    return _us(st.run_available(st.debounce_batches(_arrivals(spark, d), "36 hours"), "append", each=st.plan_closed), "first_ts")


def autosave_snapshots(spark, d):
    saves = _events(spark, d).withColumn("n_bytes", F.floor(F.col("value") / 25).cast("long"))
    return st.run_available(st.autosave_snapshots(saves), "append")


def latest_wins(spark, d):
    return st.run_available(st.latest_wins(_events(spark, d)), "update", keys=("user_id",))


def audit_stream(spark, d):
    return _us(st.run_available(st.audit_stream(_events(spark, d)), "append"), "ts")


def audit_daily(spark, d):
    return _us(st.run_available(st.audit_daily(_events(spark, d)), "append"), "day").withColumn("total", F.round("total", 4))


def ttl_cache(spark, d):
    return st.run_available(st.ttl_cache(_events(spark, d)), "append")


def first_of_the_day(spark, d):
    """Each kind of event of a user once a day: repeats have the day as their event time, so they come within the delay or are late."""
    days = _events(spark, d).select("user_id", "event_type", F.date_trunc("day", "ts").alias("ts"))
    return _us(st.run_available(st.first_in_time(days, ["user_id", "event_type", "ts"], "1 day"), "append"), "ts")


def lease_status(spark, d):
    """Revocations, deactivations, suspended licences and such that expire among activations, refreshes and checks."""
    k, i = F.col("user_id"), F.col("event_id")
    kind = F.col("event_type")
    what = F.when(kind == "view", "check").when((kind == "error") & (i % 12 == 0), "revoke").when((kind == "error") & (i % 60 == 7), "deactivate").when((kind == "signup") & (i % 20 == 0), "activate").when((kind == "purchase") & (i % 10 == 0), "refresh")
    status = F.when((k % 11 == 0) & (F.dayofmonth("ts") > 12), "suspended").otherwise("active")
    expires = F.when(k % 4 == 0, F.expr("timestamp'2024-01-10 00:00:00'") + F.make_dt_interval((k % 15).cast("int")))
    events = _events(spark, d).withColumn("what", what).where("what is not null")
    return st.run_available(st.lease_status(events.withColumns({"offline": i % 2 == 0, "status": status, "expires": expires})), "append")


def seat_admission_stream(spark, d):
    """The stream of the batch query ``seat_admission``: requests, and errors that deactivate their machine, which frees a seat."""
    e = _events(spark, d).where("event_type = 'signup' or event_type = 'error' and event_id % 5 = 0")
    k = F.col("user_id") % 40
    ends = F.when(k % 9 == 2, F.expr("timestamp'2024-01-12 00:00:00'"))
    status = F.when(k == 39, None).when(k % 8 == 1, "suspended").otherwise("active")
    requests = e.select("event_id", "ts", k.alias("licence_id"), F.col("user_id").alias("machine"), (1 + k % 3).alias("max_seats"), (F.col("event_type") == "error").alias("off"), status.alias("status"), ends.alias("expires"))
    return st.run_available(st.seat_admission(requests), "append")


def batch_plan(spark, d):
    pages = corpus.table(spark, d, "pages")
    path = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    path = F.when(F.col("page_id") % 3 == 0, F.upper(path)).when(F.col("page_id") % 3 == 1, F.translate(path, "/", "\\")).otherwise(path)
    name = F.concat(path, F.when(F.col("page_id") % 11 == 0, ".txt").otherwise(".pdf"))
    return st.batch_plan(pages.select((F.col("page_id") % 2).alias("batch_id"), F.col("page_id").alias("seq"), name.alias("path")))


#: The watermark when the stream ends, in microseconds: windows whose end it has not reached stay inside.
_MARK = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events)"


def _sessions(hours: float) -> str:
    return f"""g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= {int(hours * 3_600_000_000)} THEN 0 ELSE 1 END AS o FROM events),
        s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
        k AS (SELECT user_id, n, epoch_us(min(ts)) AS first_ts, count(*) AS arrivals FROM s GROUP BY ALL HAVING epoch_us(max(ts)) + {int(hours * 3_600_000_000)} <= {_MARK})"""


QUERIES = {
    "debounce_batches": (
        debounce_batches,
        f"""WITH {_sessions(0.25)}, t AS (SELECT user_id, n, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, n, event_type FROM s) GROUP BY ALL)
        SELECT user_id, first_ts, arrivals, kinds FROM k JOIN t USING (user_id, n)""",
    ),
    "debounced_plans": (
        debounced_plans,
        f"""WITH {_sessions(36)}, p AS (SELECT user_id, first_ts, event_id, event_type || '/File' || event_id % 40 || CASE WHEN event_id % 7 = 0 THEN '.txt' ELSE '.pdf' END AS path FROM k JOIN s USING (user_id, n)),
        q AS (SELECT user_id, first_ts, lower(path) AS n, arg_min(CASE WHEN event_id % 3 = 0 THEN upper(path) ELSE path END, event_id) AS path FROM p WHERE path LIKE '%.pdf' GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, first_ts ORDER BY lpad(regexp_extract(n, '[0-9]+'), 20, '0'), path) AS k, count(*) OVER (PARTITION BY user_id, first_ts) AS c FROM q)
        SELECT user_id, first_ts, k - 1 AS place, path, greatest(c - 60, 0) AS dropped FROM r WHERE k <= 60""",
    ),
    "autosave_snapshots": (
        autosave_snapshots,
        f"""WITH s AS (SELECT user_id, epoch_us(ts) // 7200000000 * 7200000000 AS slot, arg_max(CAST(floor(value / 25) AS BIGINT), (ts, event_id)) AS n_bytes FROM events GROUP BY ALL),
        c AS (SELECT *, lag(n_bytes) OVER (PARTITION BY user_id ORDER BY slot) AS b FROM s WHERE slot + 7200000000 <= {_MARK}) SELECT user_id, slot, n_bytes FROM c WHERE n_bytes IS DISTINCT FROM b""",
    ),
    "latest_wins": (latest_wins, "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id"),
    "audit_stream": (audit_stream, "SELECT event_id, epoch_us(ts) AS ts, user_id AS actor, event_type AS action, json_extract_string(props, '$.k') AS detail FROM events"),
    "audit_daily": (
        audit_daily,
        f"""SELECT event_type, epoch_us(ts) // 86400000000 * 86400000000 AS day, count(*) AS n, round(sum(value), 4) AS total FROM events
        WHERE epoch_us(ts) // 86400000000 * 86400000000 + 86400000000 <= {_MARK} GROUP BY ALL""",
    ),
    "ttl_cache": (
        ttl_cache,
        """WITH RECURSIVE s AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
          UNION ALL SELECT s.user_id, min(e.ts) FROM s JOIN events e ON e.user_id = s.user_id AND e.ts > s.ts + INTERVAL 3 DAY GROUP BY s.user_id, s.ts)
        SELECT event_id, user_id, (user_id, ts) NOT IN (SELECT (user_id, ts) FROM s) AS hit FROM events""",
    ),
    "first_of_the_day": (first_of_the_day, "SELECT DISTINCT user_id, event_type, epoch_us(ts) // 86400000000 * 86400000000 AS ts FROM events"),
    "lease_status": (
        lease_status,
        """WITH k AS (SELECT *, CASE WHEN event_type = 'view' THEN 'check' WHEN event_type = 'error' AND event_id % 12 = 0 THEN 'revoke' WHEN event_type = 'error' AND event_id % 60 = 7 THEN 'deactivate'
          WHEN event_type = 'signup' AND event_id % 20 = 0 THEN 'activate' WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'refresh' END AS what,
          user_id % 11 = 0 AND extract(day FROM ts) > 12 AS suspended, coalesce(user_id % 4 = 0 AND ts > TIMESTAMP '2024-01-10' + to_days(CAST(user_id % 15 AS INTEGER)), false) AS over FROM events),
        e AS (SELECT *, NOT suspended AND NOT over AS fine, row_number() OVER (PARTITION BY user_id ORDER BY ts, what = 'check', event_id) AS n FROM k WHERE what IS NOT NULL),
        b AS (SELECT *, min(CASE WHEN what = 'activate' AND fine THEN n END) OVER (PARTITION BY user_id) AS begun FROM e),
        o AS (SELECT *, min(CASE WHEN what = 'deactivate' AND n > begun THEN n END) OVER (PARTITION BY user_id) AS ended FROM b),
        v AS (SELECT *, fine AND n < coalesce(ended, n + 1) AS open, max(CASE WHEN what = 'activate' AND fine AND n < coalesce(ended, n + 1) THEN n END) OVER w AS let_in, max(CASE WHEN what = 'revoke' AND n > begun THEN n END) OVER w AS gone
          FROM o WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
        g AS (SELECT *, max(CASE WHEN open AND (what = 'activate' OR what = 'refresh' AND let_in IS NOT NULL AND coalesce(gone < let_in, true)) THEN ts END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS granted FROM v),
        a AS (SELECT *, (epoch_us(ts) - epoch_us(granted)) / 86400000000 AS days FROM g WHERE what = 'check')
        SELECT event_id, user_id, CASE WHEN let_in IS NULL THEN 'none' WHEN over THEN 'expired' WHEN suspended THEN 'suspended' WHEN days < 5 THEN 'active' WHEN days < 7 THEN 'refresh_due' WHEN days >= 21 THEN 'expired'
        WHEN event_id % 2 = 0 THEN 'grace' WHEN n > ended THEN 'deactivated' WHEN gone > let_in THEN 'revoked' ELSE 'expired' END AS token_state FROM a""",
    ),
    "seat_admission_stream": (seat_admission_stream, SEATS),
    "batch_plan": (
        batch_plan,
        """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS u FROM pages),
        n AS (SELECT page_id % 2 AS batch_id, page_id AS seq, CASE page_id % 3 WHEN 0 THEN upper(u) WHEN 1 THEN translate(u, '/', '\\') ELSE u END || '.pdf' AS path FROM p WHERE page_id % 11 <> 0),
        f AS (SELECT batch_id, lower(translate(path, '\\', '/')) AS n, arg_min(path, seq) AS path FROM n GROUP BY ALL),
        k AS (SELECT batch_id, path, array_to_string([CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(x, 20, '0') ELSE x END FOR x IN regexp_extract_all(strip_accents(string_split(n, '/')[-1]), '[0-9]+|[^0-9]+')], '') AS nat FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY nat, path) AS k, count(*) OVER (PARTITION BY batch_id) AS n FROM k)
        SELECT batch_id, k - 1 AS place, path, greatest(n - 60, 0) AS dropped FROM r WHERE k <= 60""",
    ),
}
