"""Tick custody as table jobs: overlapping batches, gap episodes, clock eligibility, retries and ledger audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.hashing import canonical, fingerprint
from barwright.functions.numeric import count_where
from barwright.operators.asof import next_tick
from barwright.operators.sequence import CHUNK, CORE, carry_forward, chunk_window, with_row_halo

ROW_LIMIT = 100_000


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: dict[str, str]) -> DataFrame:
    """Columns of the row before, over the whole series. `columns` maps new names to source columns."""
    halo = with_row_halo(df, keys, order, chunk, 1, list(dict.fromkeys(columns.values())))
    w = chunk_window(keys, order)
    out = halo.withColumns({new: F.lag(old, 1).over(w) for new, old in columns.items()})
    return out.where(F.col(CORE)).drop(CHUNK, CORE)


def assign_batches(ticks: DataFrame, width_micros: int, overlap_micros: int, order: str) -> DataFrame:
    """Overlapping polls: every tick in its own batch, ticks near the end again in the next. Order and multiplicity stay.

    A batch of any size is numbered in cells of ROW_LIMIT values of `order`, a whole number, and each cell adds what lies ahead of
    it: batches beyond the limit are kept and numbered whole (`limit_status` names them), and no task orders more than a cell. Rows
    without an order value come first.
    """
    us = F.unix_micros("ts")
    home = F.floor(us / F.lit(width_micros)).cast("bigint")
    again = F.when(F.pmod(us, F.lit(width_micros)) >= width_micros - overlap_micros, home + 1)
    rows = ticks.withColumn("batch", F.explode(F.array_compact(F.array(home, again))))
    rows = rows.withColumn("_cell", F.coalesce(F.floor(F.col(order) / F.lit(ROW_LIMIT)), F.lit(-(1 << 62))))
    cell = ["symbol", "batch", "_cell"]
    ahead = F.sum("_n").over(Window.partitionBy("symbol", "batch").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(c).alias(f"_o{c}") for c in cell], F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*cell).orderBy(order)))
    joined = placed.join(offsets, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in cell])
    return joined.select(*ticks.columns, "batch", (F.col("_ahead") + F.col("_place") - 1).cast("bigint").alias("response_index"))


def batch_table(batched: DataFrame, width_micros: int) -> DataFrame:
    """One row per batch: size, bounds, receipt at the end of its window and the lag of its cursor."""
    out = batched.groupBy("symbol", "batch").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("cursor"))
    out = out.withColumn("receipt", F.timestamp_micros((F.col("batch") + 1) * width_micros))
    return out.withColumn("lag_seconds", seconds(F.col("receipt"), F.col("cursor")))


def plan_windows(batches: DataFrame, origin: str, overlap_seconds: int, span_seconds: int, chunk: Column) -> DataFrame:
    """Next request window from the previous cursor: it starts a little before the cursor, never before the origin."""
    t0 = F.lit(origin).cast("timestamp")
    seen = previous(batches, ["symbol"], ["batch"], chunk, {"last_cursor": "cursor"})
    start = F.greatest(t0, F.coalesce(F.col("last_cursor") - F.expr(f"interval {overlap_seconds} seconds"), t0))
    end = F.least(F.col("receipt"), F.col("window_start") + F.expr(f"interval {span_seconds} seconds"))
    return seen.withColumn("window_start", start).withColumn("window_end", end).withColumn(
        "clock_regression", F.coalesce(F.col("receipt") < F.col("last_cursor"), F.lit(False)))


def duplicate_responses(batched: DataFrame, content: Sequence[str], chunk: Column) -> DataFrame:
    """Batches whose content equals the batch before; they are flagged, never dropped."""
    prints = batched.groupBy("symbol", "batch").agg(*fingerprint(content))
    names = ("row_count", "hash_sum", "hash_xor")
    seen = previous(prints, ["symbol"], ["batch"], chunk, {f"_p_{c}": c for c in names})
    same = F.lit(True)
    for c in names:
        same = same & (F.col(c) == F.col(f"_p_{c}"))
    return seen.select("symbol", "batch", "row_count", F.coalesce(same, F.lit(False)).alias("duplicate_response"))


def resolved_ticks(batched: DataFrame, identity: Sequence[str]) -> DataFrame:
    """User-level view: each tick once, credited to the first batch that held it. RAW keeps all copies."""
    return batched.groupBy(*identity).agg(F.min("batch").alias("batch"), F.count(F.lit(1)).alias("copies"))


def forward_only(ticks: DataFrame, origin: str) -> DataFrame:
    """Status of each tick under the forward-only rule."""
    return ticks.withColumn("status", F.when(F.col("ts") < F.lit(origin).cast("timestamp"), F.lit("REJECTED_BEFORE_ORIGIN")).otherwise(F.lit("ACCEPTED")))


def lag_status(batches: DataFrame, backlog: float, stop: float, patience: float, chunk: Column) -> DataFrame:
    """Status of each poll: behind its own clock, too far behind or without a new cursor for `patience` seconds, late, or normal."""
    lag = F.col("lag_seconds")
    seen = previous(batches, ["symbol"], ["batch"], chunk, {"_cursor": "cursor"})
    moved = F.coalesce(F.col("cursor") > F.col("_cursor"), F.lit(True))
    seen = carry_forward(seen, ["symbol"], ["batch"], chunk, F.when(moved, F.col("receipt")), "_progress")
    idle = seconds(F.col("receipt"), F.col("_progress"))
    return seen.withColumn("status", F.when(lag < 0, F.lit("CLOCK_REGRESSION")).when((lag > stop) | (idle >= patience), F.lit("STOP_REVIEW"))
                              .when(lag > backlog, F.lit("BACKLOG_EXCEEDED")).otherwise(F.lit("NORMAL"))).drop("_cursor", "_progress")


def episode_rows(batches: DataFrame, keys: Sequence[str], chunk: Column, open_above: float, close_at: float) -> DataFrame:
    """Per batch: whether a recovery episode is open before and after it, and the episode's opening batch.

    An episode opens on a large lag, stays open through middling ones and closes on the first small one.
    Between the marks the state is carried forward, so chunks only exchange their last mark.
    """
    lag = F.col("lag_seconds")
    mark = F.when(lag > open_above, F.lit(1)).when(lag <= close_at, F.lit(0))
    state = carry_forward(batches, keys, ["batch"], chunk, mark, "_state")
    both = previous(state, keys, ["batch"], chunk, {"_before": "_state"})
    opened = F.coalesce(F.col("_before"), F.lit(0)) == 1
    starts = (F.coalesce(F.col("_state"), F.lit(0)) == 1) & ~opened
    rows = carry_forward(both.withColumn("_open", opened), keys, ["batch"], chunk, F.when(starts, F.col("batch")), "_episode")
    inside = F.col("_open") | (F.coalesce(F.col("_state"), F.lit(0)) == 1)
    return (rows.withColumn("recovered_after_gap", inside).withColumn("episode", F.when(inside, F.col("_episode")))
                .withColumn("is_child", lag > open_above).withColumn("closes", F.col("_open") & (F.coalesce(F.col("_state"), F.lit(0)) == 0))
                .drop("_state", "_before", "_open", "_episode"))


def episodes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per recovery episode with its children and its closing batch (NULL while open)."""
    return rows.where(F.col("episode").isNotNull()).groupBy(*keys, "episode").agg(
        count_where(F.col("is_child")).alias("children"), F.count(F.lit(1)).alias("batches"),
        F.max(F.when(F.col("closes"), F.col("batch"))).alias("closed_batch"))


def reference_validity(samples: DataFrame, age: float, uncertainty: float, disagreement: float) -> DataFrame:
    ok = F.col("age_seconds").between(0, age) & (F.col("uncertainty_ms") <= uncertainty) & (F.col("disagreement_ms") <= disagreement)
    return samples.withColumn("valid", F.coalesce(ok, F.lit(False)))


def lost_intervals(samples: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, unobserved_seconds: float) -> DataFrame:
    """Intervals without a trusted clock: between two valid samples that are far apart or have an invalid one between.

    Nothing is repaired afterwards; an interval with no later valid sample stays open (NULL end).
    """
    first = samples.groupBy(*keys).agg(F.min("ts").alias("_origin"))
    carried = carry_forward(samples, keys, order, chunk, F.when(F.col("valid"), F.col("ts")), "_last_valid")
    seen = previous(carried, keys, order, chunk, {"_prev_valid": "_last_valid", "_prev_ok": "valid"})
    seen = seen.join(first, list(keys))
    start = F.coalesce("_prev_valid", "_origin")
    broken = (F.coalesce(F.col("_prev_ok"), F.lit(True)) == F.lit(False)) | (seconds(F.col("ts"), F.col("_prev_valid")) > unobserved_seconds)
    closed = seen.where(F.col("valid") & F.coalesce(broken, F.lit(False))).select(*keys, start.alias("lost_from"), F.col("ts").alias("lost_to"))
    tail = samples.groupBy(*keys).agg(F.max(F.when(F.col("valid"), F.col("ts"))).alias("_v"), F.max("ts").alias("_t"), F.min("ts").alias("_o"))
    still = tail.where(F.coalesce(F.col("_t") > F.col("_v"), F.lit(True))).select(*keys, F.coalesce("_v", "_o").alias("lost_from"), F.lit(None).cast("timestamp").alias("lost_to"))
    return closed.unionByName(still)


FAR_FUTURE = "9999-01-01 00:00:00"


def temporal_eligibility(requests: DataFrame, lost: DataFrame, keys: Sequence[str], start: str = "window_start", end: str = "window_end") -> DataFrame:
    """A request is eligible when it overlaps no lost interval.

    Lost intervals do not overlap each other, so the first one that ends after the request starts decides;
    a forward lookup finds it and no request meets more than one interval.
    """
    ends = lost.select(*keys, F.coalesce("lost_to", F.lit(FAR_FUTURE).cast("timestamp")).alias("_end"), "lost_from")
    probe = requests.withColumn("_probe", F.timestamp_micros(F.unix_micros(start) + 1))
    found = next_tick(probe, ends, keys, "_probe", "_end", "lost_from", ["lost_from"], bucket_micros=86_400_000_000)
    joined = probe.join(found, [*keys, "_probe"], "left")
    hit = F.coalesce(F.col("lost_from") < F.col(end), F.lit(False))
    return joined.withColumn("eligible", ~hit).drop("_probe", "lost_from")


def contract_intervals(observations: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, fields: Sequence[str]) -> DataFrame:
    """Validity intervals of a contract: only the projected fields open a new one, and never backwards in time."""
    hashed = observations.withColumn("contract_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("NOT_AVAILABLE")) for f in fields]), 256))
    seen = previous(hashed, keys, order, chunk, {"_before": "contract_hash"})
    changes = seen.where(F.col("_before").isNull() | (F.col("_before") != F.col("contract_hash"))).select(*keys, *order, "contract_hash", chunk.alias("_c"))
    halo = with_row_halo(changes, keys, order, F.col("_c"), 1, [], ahead=True)
    nxt = F.lead(order[0], 1).over(chunk_window(keys, order))
    return halo.withColumn("valid_to", nxt).where(F.col(CORE)).select(*keys, F.col(order[0]).alias("valid_from"), "valid_to", "contract_hash")


def absences(beats: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, limit_seconds: float) -> DataFrame:
    """Stretches between heartbeats longer than the limit."""
    seen = previous(beats, keys, order, chunk, {"previous_ts": "ts"})
    gap = seconds(F.col("ts"), F.col("previous_ts"))
    return seen.where(gap > limit_seconds).select(*keys, "previous_ts", "ts", gap.alias("absent_seconds"))


def classify_incidents(incidents: DataFrame, classes: Sequence[str], name: str = "kind") -> DataFrame:
    """Counts per class; kinds outside the vocabulary are kept under a prefix."""
    known = F.col(name).isin(*classes)
    return incidents.withColumn("classification", F.when(known, F.col(name)).otherwise(F.concat(F.lit("UNKNOWN:"), F.col(name)))).groupBy(
        "classification").agg(F.count(F.lit(1)).alias("incidents"))


def retry_outcomes(attempts: DataFrame, request: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Attempts and final status per request."""
    return attempts.groupBy(*request).agg(F.count(F.lit(1)).alias("attempts"), F.max_by("status", F.struct(*order)).alias("final_status"))


def cursor_after(outcomes: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, end: Column) -> DataFrame:
    """The cursor moves only on success and keeps its place otherwise."""
    return carry_forward(outcomes, keys, order, chunk, F.when(F.col("final_status") == "OK", end), "cursor")


def build_ledger(events: DataFrame, ledger: str, order: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Hash-chained ledger segments: (ledger, sequence, content, previous, hash).

    A chain is sequential by definition: the rows of a segment (at most ROW_LIMIT by rule) stream through one task in order, one
    digest each, and segments go side by side.
    """
    kind = events.schema[ledger].dataType.simpleString()
    rows = events.select(ledger, *order, canonical(content).alias("_content")).repartition(ledger).sortWithinPartitions(ledger, *order).select(ledger, "_content")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, sequence, previous_hash = object(), 0, ""
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != segment:
                    segment, sequence, previous_hash = key, 0, ""
                sequence += 1
                digest = hashlib.sha256(f"{sequence}|{previous_hash}|{text}".encode()).hexdigest()
                out.append((key, sequence, text, previous_hash, digest))
                previous_hash = digest
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()))],
                                             names=[ledger, "sequence", "content", "previous", "hash"])
    return rows.mapInArrow(chain, f"`{ledger}` {kind}, sequence bigint, content string, previous string, hash string")


def link_segments(chained: DataFrame, ledger: str, chunk: Column) -> DataFrame:
    """One row per segment: its events and head, and the name and head of the segment before, so that no segment can be left out."""
    heads = chained.groupBy(ledger).agg(F.count(F.lit(1)).alias("events"), F.max_by("hash", "sequence").alias("head")).withColumn("_one", F.lit(1))
    return previous(heads, ["_one"], [ledger], chunk, {"previous_ledger": ledger, "previous_head": "head"}).drop("_one")


def verify_ledger(chained: DataFrame, ledger: str) -> DataFrame:
    """First position of each segment where sequence, link or content hash fails."""
    w = Window.partitionBy(ledger).orderBy("sequence")
    digest = F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "previous", "content"), 256)
    bad = ((F.col("sequence") != F.row_number().over(w)) | (F.col("previous") != F.coalesce(F.lag("hash", 1).over(w), F.lit(""))) | (F.col("hash") != digest))
    return chained.withColumn("_bad", bad).groupBy(ledger).agg(F.count(F.lit(1)).alias("events"), F.min(F.when(F.col("_bad"), F.col("sequence"))).alias("first_violation"))


def verify_links(segments: DataFrame, ledger: str, chunk: Column) -> DataFrame:
    """Whether each segment follows the one it names, with the head it names."""
    seen = previous(segments.withColumn("_one", F.lit(1)), ["_one"], [ledger], chunk, {"_ledger": ledger, "_head": "head"})
    sound = F.col("previous_ledger").eqNullSafe(F.col("_ledger")) & F.col("previous_head").eqNullSafe(F.col("_head"))
    return seen.select(ledger, F.when(sound, F.lit("LINKED")).otherwise(F.lit("EVENT_LEDGER_INTEGRITY")).alias("link"))


def commit_digest(columns: Sequence[str] = ("batch", "cursor")) -> Column:
    """Hash of the commit that a manifest calls for: the link that `build_ledger` makes of it."""
    return F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), F.col("previous"), canonical(columns)), 256)


def reconcile_commits(manifests: DataFrame, commits: DataFrame, checkpoints: DataFrame, chunk: Column, key: str = "batch") -> DataFrame:
    """Status of every batch of a journal, by existence and by content.

    manifests: batch, sequence, previous (hash of the commit before, empty for the first), cursor; commits: batch, hash;
    checkpoints: batch, sequence, commit_hash, cursor. Each table is reduced to one row per batch before they meet.
    """
    m = manifests.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), *[F.max(c).alias(c) for c in ("sequence", "previous", "cursor")])
    c = commits.groupBy(key).agg(F.count(F.lit(1)).alias("_c"), F.max("hash").alias("hash"))
    k = checkpoints.groupBy(key).agg(F.count(F.lit(1)).alias("_k"), F.max("sequence").alias("_k_sequence"), F.max("commit_hash").alias("_k_hash"), F.max("cursor").alias("_k_cursor"))
    both = m.join(c, key, "full").join(k, key, "full").withColumn("_one", F.lit(1))
    # The commit before, or the one that the manifest before calls for where it is missing.
    both = both.withColumn("_link", F.coalesce("hash", commit_digest()))
    seen = previous(both, ["_one"], [key], chunk, {"_before": "_link", "_before_sequence": "sequence", "_before_batch": key})
    first = F.col("_before_batch").isNull()
    wrong_chain = F.when(first, (F.col("sequence") != 1) | (F.col("previous") != "")).otherwise(
        F.coalesce(F.col("sequence") != F.col("_before_sequence") + 1, F.lit(False)) | F.coalesce(F.col("previous") != F.col("_before"), F.lit(False)))
    wrong_checkpoint = (F.col("_k_sequence") != F.col("sequence")) | (F.col("_k_hash") != F.col("hash")) | (F.col("_k_cursor") != F.col("cursor"))
    status = (F.when(F.coalesce("_m", F.lit(0)) > 1, F.lit("FORK")).when(F.col("_m").isNull(), F.lit("ORPHAN")).when(F.col("_c").isNull(), F.lit("UNCOMMITTED"))
               .when(F.col("hash") != commit_digest(), F.lit("COMMIT_HASH_INCONSISTENT")).when(wrong_chain, F.lit("COMMIT_CHAIN_FORK")).when(F.col("_k").isNull(), F.lit("MISSING_CHECKPOINT"))
               .when(wrong_checkpoint, F.lit("CHECKPOINT_WITHOUT_VALID_COMMIT")).otherwise(F.lit("RECONCILED")))
    return seen.select(key, status.alias("status"))


def identity_changes(sessions: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, fields: Sequence[str]) -> DataFrame:
    """Sessions whose identity differs from the one before."""
    seen = previous(sessions.withColumn("_id", F.concat_ws("|", *fields)), keys, order, chunk, {"_before": "_id"})
    return seen.withColumn("identity_changed", F.coalesce(F.col("_before") != F.col("_id"), F.lit(False))).drop("_before", "_id")


def limit_status(batches: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    return batches.withColumn("status", F.when(F.col("rows") > limit, F.lit("ROW_LIMIT_EXCEEDED_RAW_PRESERVED"))
                              .when(F.col("rows") == 0, F.lit("EMPTY_RESPONSE")).otherwise(F.lit("WITHIN_LIMIT")))


def read_decisions(requests: DataFrame, policy: DataFrame, committed: DataFrame, fields: Sequence[str], key: str = "batch") -> DataFrame:
    """Derived reads are allowed only on an exact policy match and a committed batch."""
    rule = policy.select(*fields).distinct().withColumn("_match", F.lit(True))
    done = committed.select(key).distinct().withColumn("_done", F.lit(True))
    joined = requests.join(rule, list(fields), "left").join(done, key, "left")
    return joined.withColumn("decision", F.when(F.col("_match").isNull(), F.lit("DENY_SCOPE")).when(F.col("_done").isNull(), F.lit("DENY_UNCOMMITTED")).otherwise(
        F.lit("ALLOW"))).drop("_match", "_done")
