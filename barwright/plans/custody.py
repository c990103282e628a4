"""Custody queries: batch forms with comparison SQL and their streaming twins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from barwright.functions.numeric import rounded
from barwright.operators import custody as S
from barwright.plans.bindings import Tables, day_chunk, rounded_all
from barwright.plans.oracle import canon, r
from barwright.plans.registry import query
from barwright.session import ensure_checkpoint_dir, materialize
from barwright.streaming import capture

WIDTH, OVERLAP = 3_600_000_000, 120_000_000
ORIGIN = "2024-01-02 00:00:00"
OPEN, CLOSE, STOP = 1200.0, 300.0, 3000.0
SYM = ["symbol"]

BATCH = f"""WITH ev AS (SELECT 'EVT' AS symbol, event_id AS tick_id, ts, event_type, value, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
bt AS (SELECT *, epoch_us(ts) // {WIDTH} AS batch FROM ev UNION ALL SELECT *, epoch_us(ts) // {WIDTH} + 1 FROM ev WHERE epoch_us(ts) % {WIDTH} >= {WIDTH - OVERLAP}),
b AS (SELECT symbol, batch, count(*) AS "rows", min(ts) AS first_ts, max(ts) AS cursor, make_timestamp((batch + 1) * {WIDTH}) AS receipt, (( batch + 1) * {WIDTH} - epoch_us(max(ts))) / 1e6::DOUBLE AS lag_seconds FROM bt GROUP BY symbol, batch)"""


def week_of_batch():
    return F.floor(F.col("batch") / 168).cast("bigint")


def raw(t: Tables) -> DataFrame:
    return t.events.select(F.lit("EVT").alias("symbol"), F.col("event_id").alias("tick_id"), "ts", "event_type", "value", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def batched(t: Tables) -> DataFrame:
    return S.assign_batches(raw(t), WIDTH, OVERLAP, "tick_id")


def batches(t: Tables) -> DataFrame:
    return t.stored("batches", lambda: S.batch_table(batched(t), WIDTH))


@query("st01_batch_ingest", BATCH + " SELECT batch, tick_id, row_number() OVER (PARTITION BY batch ORDER BY tick_id) - 1 AS response_index, ts FROM bt")
def batch_ingest(t: Tables) -> DataFrame:
    return batched(t).select("batch", "tick_id", "response_index", "ts")


@query("st02_window_plan", BATCH + """, p AS (SELECT *, lag(cursor) OVER (ORDER BY batch) AS lc FROM b), s AS (SELECT *, greatest(TIMESTAMP '2024-01-02', coalesce(lc - INTERVAL 2 SECOND, TIMESTAMP '2024-01-02')) AS window_start FROM p)
 SELECT batch, window_start, least(receipt, window_start + INTERVAL 60 SECOND) AS window_end, coalesce(receipt < lc, false) AS clock_regression FROM s""")
def window_plan(t: Tables) -> DataFrame:
    return S.plan_windows(batches(t), ORIGIN, 2, 60, week_of_batch()).select("batch", "window_start", "window_end", "clock_regression")


RESPONSE = ["tick_id", "ts", "event_type", "value", "user_id", "k"]


# Every fifth poll returns the response of the poll before once more.
@query("st03_duplicate_response", BATCH + ", again AS (SELECT * FROM bt WHERE batch % 5 <> 1 UNION ALL SELECT * REPLACE (batch + 1 AS batch) FROM bt WHERE batch % 5 = 0), f AS (SELECT batch, count(*) AS row_count, list_sort(list(" + canon(*RESPONSE) +
       ")) AS h FROM again GROUP BY batch) SELECT batch, row_count, coalesce(h = lag(h) OVER w, false) AS duplicate_response FROM f WINDOW w AS (ORDER BY batch)")
def duplicate_response(t: Tables) -> DataFrame:
    polls = batched(t)
    fifth = F.pmod("batch", F.lit(5))
    again = polls.where(fifth != 1).unionByName(polls.where(fifth == 0).withColumn("batch", F.col("batch") + 1))
    return S.duplicate_responses(again, RESPONSE, week_of_batch()).drop("symbol")


@query("st04_overlap_resolution", BATCH + " SELECT tick_id, min(batch) AS batch, count(*) AS copies FROM bt GROUP BY tick_id")
def overlap_resolution(t: Tables) -> DataFrame:
    return S.resolved_ticks(batched(t), ["tick_id"])


@query("st05_forward_only", BATCH + " SELECT CASE WHEN ts < TIMESTAMP '2024-01-02' THEN 'REJECTED_BEFORE_ORIGIN' ELSE 'ACCEPTED' END AS status, count(*) AS ticks, min(ts) AS first_ts FROM ev GROUP BY 1")
def forward_only(t: Tables) -> DataFrame:
    return S.forward_only(raw(t), ORIGIN).groupBy("status").agg(F.count(F.lit(1)).alias("ticks"), F.min("ts").alias("first_ts"))


# Every seventh poll brings no new tick.
@query("st06_lag_status", BATCH + f""", p AS (SELECT batch, receipt, lag_seconds, CASE WHEN batch % 7 = 3 THEN coalesce(lag(cursor) OVER (ORDER BY batch), cursor) ELSE cursor END AS cursor FROM b),
 m AS (SELECT *, coalesce(cursor > lag(cursor) OVER (ORDER BY batch), true) AS moved FROM p), i AS (SELECT *, epoch(receipt) - epoch(last_value(CASE WHEN moved THEN receipt END IGNORE NULLS) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING)) AS idle FROM m)
 SELECT batch, {r('lag_seconds')} AS lag_seconds, CASE WHEN lag_seconds < 0 THEN 'CLOCK_REGRESSION' WHEN lag_seconds > {STOP} OR idle >= 900 THEN 'STOP_REVIEW' WHEN lag_seconds > {OPEN} THEN 'BACKLOG_EXCEEDED' ELSE 'NORMAL' END AS status FROM i""")
def lag_status(t: Tables) -> DataFrame:
    polls = S.previous(batches(t), SYM, ["batch"], week_of_batch(), {"before": "cursor"})
    polls = polls.withColumn("cursor", F.when(F.pmod("batch", F.lit(7)) == 3, F.coalesce("before", "cursor")).otherwise(F.col("cursor")))
    return S.lag_status(polls, OPEN, STOP, 900.0, week_of_batch()).select("batch", rounded("lag_seconds").alias("lag_seconds"), "status")


EPI = BATCH + f""", m AS (SELECT *, CASE WHEN lag_seconds > {OPEN} THEN 1 WHEN lag_seconds <= {CLOSE} THEN 0 END AS mk FROM b), s AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING), 0) AS st FROM m),
 p AS (SELECT *, coalesce(lag(st) OVER (ORDER BY batch), 0) AS pst FROM s), e AS (SELECT *, last_value(CASE WHEN st = 1 AND pst = 0 THEN batch END IGNORE NULLS) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS ep FROM p),
 er AS (SELECT batch, lag_seconds, st = 1 OR pst = 1 AS recovered_after_gap, CASE WHEN st = 1 OR pst = 1 THEN ep END AS episode, lag_seconds > {OPEN} AS child, pst = 1 AND st = 0 AS closes FROM e)"""
EPISODES = EPI + " SELECT episode, count(*) FILTER (child) AS children, count(*) AS batches, max(CASE WHEN closes THEN batch END) AS closed_batch FROM er WHERE episode IS NOT NULL GROUP BY episode"


@query("st07_recovery_episodes", EPISODES)
def recovery_episodes(t: Tables) -> DataFrame:
    return S.episodes(S.episode_rows(batches(t), SYM, week_of_batch(), OPEN, CLOSE), SYM).drop("symbol")


def samples(t: Tables) -> DataFrame:
    s = raw(t).select("symbol", "tick_id", "ts", (F.col("k") / 20).alias("age_seconds"), (F.col("value") * 2).alias("uncertainty_ms"), F.pmod("user_id", F.lit(105)).cast("double").alias("disagreement_ms"))
    return S.reference_validity(s, 5.0, 250.0, 100.0)


SAMPLES = BATCH + ", sm AS (SELECT symbol, tick_id, ts, coalesce(k / 20.0 BETWEEN 0 AND 5 AND value * 2 <= 250 AND user_id % 105 <= 100, false) AS valid FROM ev)"


@query("st08_reference_validity", SAMPLES + " SELECT tick_id, valid FROM sm")
def reference_validity(t: Tables) -> DataFrame:
    return samples(t).select("tick_id", "valid")


LOST = SAMPLES + """, lv AS (SELECT *, lag(valid) OVER (ORDER BY ts, tick_id) AS pok, last_value(CASE WHEN valid THEN ts END IGNORE NULLS) OVER (ORDER BY ts, tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM sm),
 lost AS (SELECT coalesce(pv, (SELECT min(ts) FROM sm)) AS lost_from, ts AS lost_to FROM lv WHERE valid AND coalesce(coalesce(pok, true) = false OR epoch_us(ts) - epoch_us(pv) > 600000000, false)
  UNION ALL SELECT coalesce(max(CASE WHEN valid THEN ts END), min(ts)), NULL FROM sm HAVING max(ts) > max(CASE WHEN valid THEN ts END))"""


def lost(t: Tables) -> DataFrame:
    return S.lost_intervals(materialize(samples(t)), SYM, ["ts", "tick_id"], day_chunk("ts", 1), 600.0)


@query("st09_lost_clock_intervals", LOST + " SELECT lost_from, lost_to FROM lost")
def lost_clock(t: Tables) -> DataFrame:
    return lost(t).drop("symbol")


@query("st10_temporal_eligibility", LOST + " SELECT batch, NOT EXISTS (SELECT 1 FROM lost WHERE b.first_ts < coalesce(lost_to, TIMESTAMP '9999-01-01') AND b.cursor > lost_from) AS eligible FROM b")
def eligibility(t: Tables) -> DataFrame:
    return S.temporal_eligibility(batches(t), materialize(lost(t)), SYM, "first_ts", "cursor").select("batch", "eligible")


@query("st11_contract_intervals", """WITH h AS (SELECT o_custkey, o_orderdate, o_orderkey, sha256(concat_ws('|', o_orderpriority, o_orderstatus)) AS contract_hash FROM orders), c AS (SELECT *, lag(contract_hash) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM h),
 x AS (SELECT * FROM c WHERE p IS NULL OR p <> contract_hash) SELECT o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, contract_hash FROM x""")
def contract_intervals(t: Tables) -> DataFrame:
    o = t.read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return S.contract_intervals(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.year("o_orderdate"), ["o_orderpriority", "o_orderstatus"])


@query("st12_heartbeat_absence", BATCH + f", g AS (SELECT event_type, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, tick_id) AS previous_ts, ts FROM ev) SELECT event_type, previous_ts, ts, {r('(epoch_us(ts) - epoch_us(previous_ts)) / 1e6')} AS absent_seconds FROM g WHERE epoch_us(ts) - epoch_us(previous_ts) > 3600000000")
def heartbeat(t: Tables) -> DataFrame:
    return rounded_all(S.absences(raw(t), ["event_type"], ["ts", "tick_id"], day_chunk("ts", 1), 3600.0), ["absent_seconds"])


KIND = "CASE WHEN k < 10 THEN 'API_ERROR' WHEN event_type = 'error' THEN 'TERMINAL_' || (k % 3) WHEN k > 90 THEN 'BACKLOG_EXCEEDED' ELSE event_type END"


@query("st13_incident_classes", BATCH + f", i AS (SELECT {KIND} AS kind FROM ev) SELECT CASE WHEN kind IN ('API_ERROR', 'BACKLOG_EXCEEDED', 'TERMINAL_0') THEN kind ELSE 'UNKNOWN:' || kind END AS classification, count(*) AS incidents FROM i GROUP BY 1")
def incidents(t: Tables) -> DataFrame:
    return S.classify_incidents(raw(t).withColumn("kind", F.expr(KIND)), ["API_ERROR", "BACKLOG_EXCEEDED", "TERMINAL_0"])


@query("st14_retry_outcomes", BATCH + f""", a AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, ts, tick_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'OK' END AS status FROM ev), o AS (SELECT user_id, day, count(*) AS attempts, arg_max(status, (ts, tick_id)) AS final_status FROM a GROUP BY ALL)
 SELECT *, max(CASE WHEN final_status = 'OK' THEN day END) OVER (PARTITION BY user_id ORDER BY day) AS cursor FROM o""")
def retries(t: Tables) -> DataFrame:
    attempts = raw(t).select("user_id", F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)).cast("bigint").alias("day"), "ts", "tick_id", F.when(F.col("event_type") == "error", "FAILED").otherwise("OK").alias("status"))
    outcomes = S.retry_outcomes(attempts, ["user_id", "day"], ["ts", "tick_id"])
    return S.cursor_after(outcomes, ["user_id"], ["day"], F.floor(F.col("day") / 366).cast("bigint"), F.col("day"))


@query("st15_ledger_verification", BATCH + f", q AS (SELECT epoch_us(ts) // {WIDTH} AS ledger, event_type, row_number() OVER (PARTITION BY epoch_us(ts) // {WIDTH} ORDER BY tick_id) AS seq FROM ev) SELECT ledger, count(*) AS events, min(CASE WHEN event_type = 'error' THEN seq END) AS first_violation FROM q GROUP BY ledger")
def ledger(t: Tables) -> DataFrame:
    """Chained hourly segments in which the content of error events was altered afterwards."""
    chain = hourly_chain(t)
    altered = chain.withColumn("content", F.when(F.col("content").contains(":error"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return S.verify_ledger(altered, "ledger")


def hourly_chain(t: Tables) -> DataFrame:
    ev = raw(t).withColumn("ledger", F.floor(F.unix_micros("ts") / F.lit(WIDTH)).cast("bigint"))
    return materialize(S.build_ledger(ev, "ledger", ["tick_id"], ["tick_id", "event_type", "user_id"]))


def week_of_ledger():
    return F.floor(F.col("ledger") / 168).cast("bigint")


@query("st15_segment_links", f"""WITH a AS (SELECT DISTINCT epoch_us(ts) // {WIDTH} AS ledger FROM events), l AS (SELECT ledger, lag(ledger) OVER (ORDER BY ledger) AS named FROM a), k AS (SELECT *, lag(ledger) OVER (ORDER BY ledger) AS found FROM l WHERE ledger % 23 <> 7)
 SELECT ledger, CASE WHEN named IS DISTINCT FROM found THEN 'EVENT_LEDGER_INTEGRITY' ELSE 'LINKED' END AS link FROM k""")
def segment_links(t: Tables) -> DataFrame:
    """The chain of segments after some of them were removed as a whole."""
    segments = materialize(S.link_segments(hourly_chain(t), "ledger", week_of_ledger()))
    return S.verify_links(segments.where(F.pmod("ledger", F.lit(23)) != 7), "ledger", week_of_ledger())


H = "('0x' || substr(md5('c:' || batch), 1, 8))::BIGINT % 16"


@query("st16_commit_reconcile", BATCH + f""", h AS (SELECT batch, {H} AS s, lag({H}) OVER (ORDER BY batch) AS p FROM b)
 SELECT batch, CASE WHEN s = 4 THEN 'FORK' WHEN s = 3 THEN 'ORPHAN' WHEN s = 1 THEN 'UNCOMMITTED' WHEN s = 5 THEN 'COMMIT_HASH_INCONSISTENT' WHEN s = 6 OR coalesce(p IN (5, 6), false) THEN 'COMMIT_CHAIN_FORK' WHEN s = 2 THEN 'MISSING_CHECKPOINT' WHEN s = 7 THEN 'CHECKPOINT_WITHOUT_VALID_COMMIT' ELSE 'RECONCILED' END AS status FROM h""")
def commit_reconcile(t: Tables) -> DataFrame:
    """A journal in which hashes decide which record of a batch was lost, forked or altered."""
    from barwright.functions.hashing import canonical, hashed_int
    polls = batches(t).select("symbol", "batch", "cursor")
    chain = S.build_ledger(polls, "symbol", ["batch"], ["batch", "cursor"])
    made = chain.join(polls.withColumn("content", canonical(["batch", "cursor"])), ["symbol", "content"]).withColumn("s", F.pmod(hashed_int(F.lit("c"), "batch"), F.lit(16)))
    # A branch of its own: consistent in itself, but not with the commits around it.
    made = materialize(made.withColumn("previous", F.when(F.col("s") == 6, F.lit("another branch")).otherwise(F.col("previous"))).withColumn("hash", S.commit_digest()))
    manifests = made.where("s <> 3").unionByName(made.where("s = 4")).select("batch", "sequence", "previous", "cursor")
    commits = made.where("s <> 1").select("batch", F.when(F.col("s") == 5, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"))
    checkpoints = made.where("s <> 2").select("batch", "sequence", F.col("hash").alias("commit_hash"), F.when(F.col("s") == 7, F.col("cursor") + F.expr("interval 1 second")).otherwise(F.col("cursor")).alias("cursor"))
    return S.reconcile_commits(manifests, commits, checkpoints, week_of_batch())


@query("st17_identity_change", BATCH + """, d AS (SELECT strftime(ts, '%Y-%m-%d') AS session, arg_min(event_type, tick_id) AS server, arg_min(user_id % 2, tick_id) AS account FROM ev GROUP BY 1)
 SELECT session, server, account, coalesce(server || '|' || account <> lag(server || '|' || account) OVER (ORDER BY session), false) AS identity_changed FROM d""")
def identity_change(t: Tables) -> DataFrame:
    d = raw(t).groupBy("symbol", F.date_format("ts", "yyyy-MM-dd").alias("session")).agg(F.min_by("event_type", "tick_id").alias("server"), F.min_by(F.pmod("user_id", F.lit(2)), F.col("tick_id")).alias("account"))
    return S.identity_changes(d, SYM, ["session"], F.substring("session", 1, 7), ["server", "account"]).drop("symbol")


@query("st18_recovered_batches", EPI + " SELECT batch, recovered_after_gap, episode FROM er")
def recovered(t: Tables) -> DataFrame:
    return S.episode_rows(batches(t), SYM, week_of_batch(), OPEN, CLOSE).select("batch", "recovered_after_gap", "episode")


@query("st19_row_limits", BATCH + " SELECT batch, \"rows\", CASE WHEN \"rows\" > 20 THEN 'ROW_LIMIT_EXCEEDED_RAW_PRESERVED' ELSE 'WITHIN_LIMIT' END AS status FROM b")
def row_limits(t: Tables) -> DataFrame:
    return S.limit_status(batches(t), 20).select("batch", "rows", "status")


@query("st20_derived_read_scope", BATCH + f""", rq AS (SELECT tick_id, event_type AS purpose, CASE WHEN k < 50 THEN 'DEMO' ELSE 'LIVE' END AS environment, epoch_us(ts) // {WIDTH} AS batch FROM ev), h AS (SELECT batch, {H} AS s FROM b)
 SELECT tick_id, CASE WHEN NOT ((purpose = 'view' OR purpose = 'click') AND environment = 'DEMO') THEN 'DENY_SCOPE' WHEN batch NOT IN (SELECT batch FROM h WHERE s <> 1) THEN 'DENY_UNCOMMITTED' ELSE 'ALLOW' END AS decision FROM rq""")
def derived_reads(t: Tables) -> DataFrame:
    from barwright.functions.hashing import hashed_int
    rq = raw(t).select("tick_id", F.col("event_type").alias("purpose"), F.when(F.col("k") < 50, "DEMO").otherwise("LIVE").alias("environment"), F.floor(F.unix_micros("ts") / F.lit(WIDTH)).cast("bigint").alias("batch"))
    policy = t.spark.createDataFrame([("view", "DEMO"), ("click", "DEMO")], "purpose string, environment string")
    committed = batches(t).where(F.pmod(hashed_int(F.lit("c"), "batch"), F.lit(16)) != 1)
    return S.read_decisions(rq, policy, committed, ["purpose", "environment"]).select("tick_id", "decision")


# ---- streaming twins ---------------------------------------------------------------------------------

SLICES, DELAY = 8, "3 days"
# Landing of the ticks in eight slices in order of time; one in eleven comes a slice later, one in thirty-seven three slices later.
LANDED = f"""WITH ev AS (SELECT *, least({SLICES - 1}, (epoch_us(ts) - epoch_us((SELECT min(ts) FROM events))) * {SLICES} // (epoch_us((SELECT max(ts) FROM events)) - epoch_us((SELECT min(ts) FROM events)) + 1)
 + CASE WHEN event_id % 37 = 5 THEN 3 WHEN event_id % 11 = 4 THEN 1 ELSE 0 END)::INT AS slice FROM events)"""


def landings(t: Tables, out: str, copies: int = 1) -> Iterator[DataFrame]:
    """The events as they would land, one slice after the other; after each the stream of what has landed, to be drained before the next."""
    ends = t.events.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).first()
    home = F.floor((F.unix_micros("ts") - ends["a"]) * SLICES / (ends["b"] - ends["a"] + 1))
    late = F.when(F.pmod("event_id", F.lit(37)) == 5, 3).when(F.pmod("event_id", F.lit(11)) == 4, 1).otherwise(0)
    rows = t.events.withColumn("slice", F.least(F.lit(SLICES - 1), home + late).cast("int"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    for part in range(SLICES):
        # Copies come a slice later, as overlapping polls bring them.
        capture.land(rows.where(F.least(F.col("slice") + F.col("_copy"), F.lit(SLICES - 1)) == part).drop("_copy", "slice"), f"{out}/landing", "event_id")
        yield capture.tick_stream(t.spark, f"{out}/landing", t.events.schema, files_per_trigger=None)


def _out(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


@query("st01_stream_ingest", "SELECT event_id, ts, user_id FROM events")
def stream_ingest(t: Tables) -> DataFrame:
    out = _out(t)
    for stream in landings(t, out):
        capture.ingest(stream, f"{out}/data", f"{out}/journal")
    return t.spark.read.parquet(f"{out}/data").select("event_id", "ts", "user_id")


@query("st04_stream_dedupe", "SELECT event_id FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """Every tick arrives twice, in two slices, as overlapping polls deliver it, some long after their time; one copy passes."""
    out = _out(t)
    for stream in landings(t, out, copies=2):
        capture.run_to_table(capture.deduplicated(stream, ["event_id"], "1 hour"), f"{out}/data", f"{out}/journal")
    return t.spark.read.parquet(f"{out}/data").select("event_id")


@query("st05_stream_late_split", "SELECT event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-02' THEN 'rejected' ELSE 'accepted' END AS status FROM events")
def stream_late(t: Tables) -> DataFrame:
    """Accepted and rejected ticks together are those received."""
    out = _out(t)
    for stream in landings(t, out):
        capture.split_by_origin(stream, f"{out}/data", f"{out}/journal", ORIGIN)
    return t.spark.read.parquet(f"{out}/data").select("event_id", "ts", "status")


LEDGER = EPI.replace("'EVT' AS symbol", "event_type AS symbol").replace("(ORDER BY batch", "(PARTITION BY symbol ORDER BY batch").replace("SELECT batch, lag_seconds, st = 1", "SELECT symbol, batch, lag_seconds, st = 1")


@query("st07_stream_episodes", LEDGER + " SELECT symbol, episode, count(*) FILTER (child) AS children, count(*) AS batches, max(CASE WHEN closes THEN batch END) AS closed_batch FROM er WHERE episode IS NOT NULL GROUP BY symbol, episode")
def stream_episodes(t: Tables) -> DataFrame:
    """The batch ledger of each event type replayed in four slices through the stateful operator, open episodes included."""
    out = _out(t)
    ledger = materialize(S.batch_table(S.assign_batches(raw(t).withColumn("symbol", F.col("event_type")), WIDTH, OVERLAP, "tick_id"), WIDTH).select("symbol", "batch", "lag_seconds"))
    ends = ledger.agg(F.min("batch").alias("a"), F.max("batch").alias("b")).first()
    for part in range(4):
        capture.land(ledger.where(F.floor((F.col("batch") - ends["a"]) * 4 / (ends["b"] - ends["a"] + 1)) == part), f"{out}/ledger", "symbol", "batch")
        source = capture.tick_stream(t.spark, f"{out}/ledger", ledger.schema, files_per_trigger=None)
        capture.run_to_table(capture.episodes(source, OPEN, CLOSE), f"{out}/data", f"{out}/journal")
    return capture.episode_table(t.spark.read.schema(capture.EPISODE_OUTPUT).parquet(f"{out}/data"))


@query("st12_stream_heartbeat_sessions", LANDED + f""", nw AS (SELECT slice, max(ts) AS newest FROM ev GROUP BY slice), wm AS (SELECT a.slice, max(b.newest) AS newest FROM nw a LEFT JOIN nw b ON b.slice < a.slice GROUP BY a.slice),
 st AS (SELECT ev.*, coalesce(ts < newest - INTERVAL {DELAY}, false) AS late FROM ev JOIN wm USING (slice)), g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) > 3600000000, true)::INT AS fresh FROM st WHERE NOT late),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT event_type, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS beats FROM s GROUP BY event_type, n UNION ALL SELECT event_type || ':late', NULL, NULL, count(*) FROM st WHERE late GROUP BY event_type""")
def stream_heartbeats(t: Tables) -> DataFrame:
    """Sessions of the accepted beats, the open ones flushed, and how many beats of each type came too late."""
    out = _out(t)
    for stream in landings(t, out):
        capture.split_late(stream, f"{out}/split", f"{out}/split-journal", DELAY)
    ticks = t.spark.read.parquet(f"{out}/split/ticks")
    accepted = ticks.where("status = 'accepted'").select("event_type", "ts", "micro_batch")
    beats = accepted.select("event_type", "ts")
    # One beat of no type far behind the last one closes every session.
    flush = beats.agg(F.lit("flush").alias("event_type"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"))
    for part in [*range(SLICES), None]:
        rows = flush if part is None else accepted.where(F.col("micro_batch") == part).select("event_type", "ts")
        capture.land(rows, f"{out}/beats", "event_type", "ts")
        stream = capture.tick_stream(t.spark, f"{out}/beats", beats.schema, files_per_trigger=None)
        capture.run_to_table(capture.heartbeat_sessions(stream, "ts", "event_type", "60 minutes", DELAY), f"{out}/data", f"{out}/journal")
    sessions = t.spark.read.parquet(f"{out}/data").where("event_type <> 'flush'")
    late = ticks.where("status = 'rejected'").groupBy("event_type").agg(F.count(F.lit(1)).alias("beats"))
    return sessions.unionByName(late.withColumn("event_type", F.concat("event_type", F.lit(":late"))), allowMissingColumns=True)
