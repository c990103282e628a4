"""Store queries: filtered retrieval, nearest neighbours, hashes, replay, guard and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from barwright.functions.numeric import rounded
from barwright.operators import retrieval as R
from barwright.operators.features import calendar_partition
from barwright.plans import oracle
from barwright.plans.bindings import QUARTER, Tables, rounded_all
from barwright.plans.features import ESQL, POLICY, QSQL, experiences
from barwright.plans.registry import query
from barwright.session import ensure_checkpoint_dir
from barwright.sources import files, sinks


@query("src04_store_query", ESQL + f" SELECT ts, session_id, {oracle.r('state_vol_short')} AS state_vol_short, {oracle.r('net_5')} AS net_5 FROM exps WHERE action = 'LONG' AND state_regime = 'RANGE' AND session_id = '2024-01-15'")
def store_query(t: Tables) -> DataFrame:
    rows = files.store_query(experiences(t), ["ts", "session_id", "state_vol_short", "net_5"], action="LONG", regime="RANGE", session="2024-01-15")
    return rounded_all(rows, ["state_vol_short", "net_5"])


@query("src04_store_query_by_ids", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'A')""")
def store_by_ids(t: Tables) -> DataFrame:
    """A table of ids becomes a semi join."""
    ids = t.read("lineitem").where("l_quantity >= 49 AND l_returnflag = 'A'").select(F.col("l_orderkey").alias("experience_id"))
    rows = t.read("orders").withColumn("experience_id", F.col("o_orderkey"))
    return files.store_query(rows, ["o_orderkey", "o_totalprice"], ids=ids)


@query("x01_attribute_filter", ESQL + f""" SELECT ts, action, state_regime, {oracle.r('gross_3')} AS gross_3 FROM exps WHERE symbol = 'EVT' AND state_regime IN ('TREND_UP', 'TREND_DOWN')
  AND action IN ('LONG', 'SHORT') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def attribute_filter(t: Tables) -> DataFrame:
    rows = R.attribute_filter(experiences(t), {"symbol": "EVT"}, {"state_regime": ["TREND_UP", "TREND_DOWN"], "action": ["LONG", "SHORT"]},
                              {"ts": (F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))})
    return rows.select("ts", "action", "state_regime", rounded("gross_3").alias("gross_3"))


@query("x02_nearest_vectors", """WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, max(x) - min(x) AS span FROM u GROUP BY i),
d AS (SELECT vec_id, avg(abs(x - qv[u.i]::DOUBLE) / CASE WHEN span > 0 THEN span ELSE 1 END) AS distance FROM u JOIN s USING (i) CROSS JOIN q GROUP BY vec_id)
SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY distance, vec_id LIMIT 10""")
def nearest_vectors(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    first = e.orderBy("vec_id").limit(1)
    return R.nearest_vectors(e, first, "embedding", 64, 10, "vec_id").select("vec_id", rounded("distance").alias("distance"))


@query("x02_nearest_vectors_batch", """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, max(x) - min(x) AS span FROM u GROUP BY i),
d AS (SELECT a.vec_id AS query, b.vec_id, avg(abs(b.x - a.x) / CASE WHEN span > 0 THEN span ELSE 1 END) AS distance FROM u a JOIN u b USING (i) JOIN s USING (i) WHERE a.vec_id % 100 = 0 GROUP BY ALL)
SELECT query, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id)::INT AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 10""")
def nearest_vectors_batch(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    return R.nearest_vectors_of(e, e.where(F.pmod("vec_id", F.lit(100)) == 0), "embedding", "vec_id", 10).withColumn("distance", rounded("distance"))


FIELDS = ["state_vol_short", "state_vol_long", "state_atr", "state_dist_high", "state_dist_low", "state_return_5", "state_spread_points", "minute"]


@query("x02_nearest_states", QSQL + ", q AS (SELECT * FROM states ORDER BY ts DESC LIMIT 1), s AS (SELECT " + ", ".join(f"max({f}) - min({f}) AS s_{f}" for f in FIELDS) +
       " FROM states), d AS (SELECT states.ts, list_avg(list_filter([" + ", ".join(
           f"abs(states.{f} - q.{f}) / CASE WHEN s_{f} > 0 THEN s_{f} ELSE 1 END" for f in FIELDS) +
       "], lambda x: x IS NOT NULL)) AS distance FROM states, q, s) SELECT ts, round(distance, 6) AS distance FROM d WHERE distance IS NOT NULL ORDER BY distance, ts LIMIT 20")
def nearest_states(t: Tables) -> DataFrame:
    states = t.stored("states", lambda: t.frame(QUARTER))
    last = states.orderBy(F.desc("ts")).limit(1)
    return R.nearest(states, last, FIELDS, 20, "ts").select("ts", rounded("distance").alias("distance"))


HASHED = ["event_id", "user_id", "event_type", "cents"]
EV = "(SELECT *, round(value * 100)::BIGINT AS cents FROM events)"
CANON = oracle.canon(*HASHED)


def hashed_events(t: Tables) -> DataFrame:
    return t.events.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


@query("h01_record_hash", f"SELECT event_id, sha256({oracle.canon(*HASHED, version='V1')}) AS record_hash FROM {EV}")
def record_hashes(t: Tables) -> DataFrame:
    return R.with_record_hash(hashed_events(t), "V1", HASHED).select("event_id", "record_hash")


FP = f"count(*) AS row_count, sum(('0x' || substr(md5({CANON}), 1, 8))::BIGINT)::VARCHAR AS hash_sum, bit_xor(('0x' || substr(md5({CANON}), 9, 8))::BIGINT) AS hash_xor"


@query("h02_fingerprint", f"SELECT event_type, {FP} FROM {EV} GROUP BY event_type")
def fingerprints(t: Tables) -> DataFrame:
    out = R.dataset_fingerprints(hashed_events(t), "event_type", HASHED)
    return out.withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query("h03_manifest_check", """SELECT event_type, count(*) AS row_count, CASE WHEN event_type = 'error' THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM events GROUP BY event_type""")
def manifest_check(t: Tables) -> DataFrame:
    """A manifest taken before one dataset was altered."""
    rows = hashed_events(t)
    altered = rows.withColumn("cents", F.when(F.col("event_type") == "error", F.col("cents") + 1).otherwise(F.col("cents")))
    return R.verify_manifest(R.dataset_fingerprints(altered, "event_type", HASHED), R.dataset_fingerprints(rows, "event_type", HASHED), "event_type")


@query("x03_replay", """SELECT event_type, count(*) AS records, CASE WHEN event_type = 'error' THEN count(*) ELSE 0 END AS altered FROM events GROUP BY event_type""")
def replay(t: Tables) -> DataFrame:
    stored = R.with_record_hash(hashed_events(t), "V1", HASHED)
    altered = stored.withColumn("cents", F.when(F.col("event_type") == "error", F.col("cents") + 1).otherwise(F.col("cents")))
    checked = R.replay(altered, "V1", HASHED)
    return checked.groupBy("event_type").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("intact")).alias("altered"))


PHASES = "CASE event_type WHEN 'view' THEN 'DISCOVERY' WHEN 'click' THEN 'DISCOVERY' WHEN 'purchase' THEN 'VALIDATION' ELSE 'UNKNOWN' END"


@query("x04_partition_guard", f"""SELECT phase, partition, CASE WHEN (phase = 'DISCOVERY' AND partition = 'DEV') OR (phase = 'VALIDATION' AND partition = 'VALIDATION') THEN 'ALLOWED' ELSE 'DENIED' END AS decision,
  count(*) AS requests FROM (SELECT {PHASES} AS phase, CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-17' THEN 'DEV' WHEN ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-23' THEN 'VALIDATION'
  WHEN ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-29' THEN 'LOCKED_OOS' ELSE 'OUTSIDE' END AS partition FROM events) GROUP BY ALL""")
def guard(t: Tables) -> DataFrame:
    requests = calendar_partition(t.events, "ts", POLICY).withColumn("phase", F.expr(PHASES))
    return R.access_log(requests)


def _target(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/publish-{uuid.uuid4().hex}"


@query("snk01_idempotent_publish", oracle.bars(60) + " SELECT count(*) AS bars, 'PUBLISHED' AS first, 'UNCHANGED' AS again, 'CONFLICT' AS other FROM bars")
def idempotent_publish(t: Tables) -> DataFrame:
    """Publish, publish the same content again, then try other content under the same name."""
    path, bars = _target(t), t.bars(60)
    outcomes = [sinks.publish(bars, path), sinks.publish(bars.orderBy(F.desc("ts")), path)]
    try:
        outcomes.append(sinks.publish(bars.withColumn("close", F.col("close") + 1), path))
    except sinks.PublishConflict:
        outcomes.append("CONFLICT")
    counted = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("bars"))
    return counted.select("bars", *[F.lit(o).alias(n) for o, n in zip(outcomes, ("first", "again", "other"))])


@query("snk02_partitioned_parquet", oracle.bars(60) + f" SELECT ts, {oracle.r('close')} AS close, strftime(ts, '%Y-%m-%d') AS day FROM bars WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-20'")
def partitioned_parquet(t: Tables) -> DataFrame:
    path = _target(t)
    sinks.write_parquet(t.bars(60).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), path, ["day"])
    back = t.spark.read.parquet(path).where(F.col("day") >= "2024-01-20")
    return back.select("ts", rounded("close").alias("close"), F.col("day").cast("string").alias("day"))


@query("snk03_csv_export", oracle.bars(60) + f" SELECT ts, {oracle.r('close')} AS close, tick_volume FROM bars")
def csv_export(t: Tables) -> DataFrame:
    path = _target(t)
    sinks.write_csv(t.bars(60).select("ts", "close", "tick_volume"), path)
    back = t.spark.read.csv(path, header=True, schema="ts TIMESTAMP, close DOUBLE, tick_volume DOUBLE", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return back.withColumn("close", rounded("close"))
