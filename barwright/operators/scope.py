"""Lineage-scoped access as set and interval algebra over certificate tables.

A certificate row: id, capabilities, fields, purposes, consumers (string arrays), instrument, partition,
period_from/period_to, valid_from/valid_to, revoked. Parent edges: (child, parent).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.numeric import failed_names
from barwright.session import materialize

MAX_DEPTH = 32
MAX_PARENTS = 32
# Ways per certificate beyond which they are continued by short steps instead of by everything their ends reach.
SPREAD = 8
# Most parent edges that every task may hold, and the most pairs of a start and a certificate that it walks at once.
EDGES_HELD, PAIRS_HELD = 2_000_000, 8_000_000
SETS = ("capabilities", "fields", "purposes", "consumers")


def _onward(ways: DataFrame, reach: DataFrame, max_depth: int) -> DataFrame:
    """The ways continued by what their ends reach."""
    more = reach.where("depth > 0").select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("depth").alias("_more"))
    return ways.join(more, "ancestor").select("id", F.col("_far").alias("ancestor"), F.least(F.col("depth") + F.col("_more"), F.lit(max_depth)).alias("depth"))


def _longest(ways: DataFrame) -> DataFrame:
    return materialize(ways.groupBy("id", "ancestor").agg(F.max("depth").alias("depth")))


def _hops(reach: DataFrame, length: int, top: int) -> DataFrame:
    """The closure from all ways of up to `length`, where many ways lead from a certificate to the same ancestors.

    A round continues the ways found last by steps of up to `length`. Whatever lies on a loop is at the limit at once, and so is all that follows; such a
    pair is continued only once, so that the rows joined stay a small multiple of the pairs found. Rounds grow with the longest chain over `length`.
    """
    ends = reach.select(F.col("id").alias("name")).union(reach.select("ancestor")).distinct()
    numbers = materialize(ends.withColumn("number", F.monotonically_increasing_id()))

    def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
        for end in ("id", "ancestor"):
            df = df.join(numbers.select(F.col(old).alias(end), F.col(new).alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
        return df.select("id", "ancestor", "depth")
    coded = materialize(renamed(reach, "name", "number"))
    loops = coded.where("id = ancestor AND depth > 0").select("ancestor", F.lit(top).alias("_top"))
    found = materialize(coded.join(loops, "ancestor", "left").select("id", "ancestor", F.coalesce("_top", "depth").alias("depth")))
    step = found.where("depth > 0").select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("depth").alias("_more"))
    ways, at = found.where(F.col("depth").isin(length, top)), length
    while not ways.isEmpty():
        at = min(at + length, top)
        more = ways.select("id", "ancestor", "depth").join(step, "ancestor").select("id", F.col("_far").alias("ancestor"), F.least(F.col("depth") + F.col("_more"), F.lit(top)).alias("depth"))
        both = found.select("id", "ancestor", "depth", F.col("depth").alias("_old")).unionByName(more.withColumn("_old", F.lit(-1)))
        found = materialize(both.groupBy("id", "ancestor").agg(F.max("depth").alias("depth"), F.max("_old").alias("_old")))
        ways = found.where((F.col("depth") > F.col("_old")) & F.col("depth").isin(at, top))
    return renamed(found.select("id", "ancestor", "depth"), "number", "name")


def walks(starts: np.ndarray, first: np.ndarray, parents: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, ancestor, longest way of at most max_depth) of all starts; the parents of n are parents[first[n]:first[n + 1]].

    All starts go up one step at a time. Whatever the last step reaches is at the limit, and so is all that follows.
    """
    nodes = len(first) - 1
    depth = np.full(len(starts) * nodes, -1, np.int32)

    def onward(pairs: np.ndarray) -> np.ndarray:
        row, node = np.divmod(pairs, nodes)
        count = first[node + 1] - first[node]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[node], count)
        return np.unique(np.repeat(row, count) * nodes + parents[place])

    pairs, step = np.arange(len(starts)) * nodes + starts, 0
    while len(pairs):
        depth[pairs] = step
        pairs, step = onward(pairs), min(step + 1, max_depth)
        if step == max_depth:
            pairs = pairs[depth[pairs] < max_depth]
    found = np.flatnonzero(depth >= 0)
    row, ancestor = np.divmod(found, nodes)
    return starts[row], ancestor, depth[found]


def _walked(nodes: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The closure where every task holds the edges: each certificate is walked from in one place, and no pair is shuffled."""
    spark, kind = nodes.sparkSession, nodes.schema["id"].dataType.simpleString()
    table = edges.toArrow()
    names = pc.unique(pa.chunked_array([*table["child"].chunks, *table["parent"].chunks], table.schema.field("child").type))
    child, parent = (pc.index_in(table[end], names).to_numpy() for end in ("child", "parent"))
    order = np.lexsort((parent, child))
    first = np.searchsorted(child[order], np.arange(len(names) + 1))
    graph = spark.sparkContext.broadcast((names, first, parent[order].astype(np.int64)))
    # A child without a certificate of its own is not its own ancestor.
    starts = nodes.select("id", F.lit(True).alias("own")).unionByName(edges.select(F.col("child").alias("id"), F.lit(False).alias("own"))).groupBy("id").agg(F.max("own").alias("own"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(child) // 5000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, parents = graph.value
        for batch in batches:
            number = pc.index_in(batch.column(0), names)  # null: in no edge
            alone = pc.is_null(number)
            apart = batch.column(0).filter(alone)
            yield pa.RecordBatch.from_arrays([apart, apart, pa.array(np.zeros(len(apart), np.int32))], names=["id", "ancestor", "depth"])
            own, at = (pc.filter(column, pc.invert(alone)).to_numpy(zero_copy_only=False) for column in (batch.column(1), number))
            has_row = np.zeros(len(first) - 1, bool)
            has_row[at[own]] = True
            some = max(1, PAIRS_HELD // len(first))
            for i in range(0, len(at), some):
                start, ancestor, depth = walks(at[i:i + some].astype(np.int64), first, parents, max_depth)
                keep = (depth > 0) | has_row[start]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(start[keep])), names.take(pa.array(ancestor[keep])), pa.array(depth[keep])], names=["id", "ancestor", "depth"])

    return starts.repartition(parts, "id").mapInArrow(run, f"id {kind}, ancestor {kind}, depth int")


def ancestor_closure(nodes: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, ancestor, depth): every ancestor of every certificate, itself included, and the longest way there, at most max_depth.

    No ancestor is left out; a depth at the limit marks a cycle or a chain that is too deep. Up to EDGES_HELD edges are held by every task, and only
    the certificates are dealt out; more edges are joined.
    """
    links = materialize(edges.select("child", "parent").distinct())
    if links.count() <= EDGES_HELD:
        return _walked(nodes, links.where("child IS NOT NULL AND parent IS NOT NULL"), max_depth)
    return _joined(nodes, links, max_depth)


def _joined(nodes: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The closure by joins, for any number of edges.

    Semi-naive doubling: a round continues only the ways as long as the round before could find, so a way is joined once, and the rounds
    grow with the logarithm of the longest chain. Lengths are followed up to a power of two. Beyond it only new pairs count, and one join at the end marks whatever ways of that length lead to.
    Once there are more than SPREAD ways of a length per certificate, doubling would join each of them to hundreds of ancestors: short steps go on.
    """
    top = 1 << max(max_depth - 1, 0).bit_length()
    reach = _longest(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(
        edges.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))))
    length = 1
    # A way of up to twice the length is one of exactly this length and a rest; both are in `reach`.
    ways = reach.where("depth = 1")
    while length < top and not ways.isEmpty():
        if ways.count() > SPREAD * ways.select("id").distinct().count():
            return _hops(reach, length, top).withColumn("depth", F.least("depth", F.lit(max_depth)))
        reach, length = _longest(reach.unionByName(_onward(ways, reach, top))), 2 * length
        ways = reach.where(F.col("depth") == length)
    deep = materialize(ways)
    ways = deep
    while not ways.isEmpty():
        fresh = materialize(_onward(ways, reach, top).distinct().join(reach, ["id", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            reach = _longest(reach.unionByName(_onward(deep, reach, top)))
            break
        reach = reach.unionByName(fresh)
        ways = materialize(_onward(ways, ways, top).distinct())
    return reach.withColumn("depth", F.least("depth", F.lit(max_depth)))


def graph_status(max_depth: int = MAX_DEPTH) -> Column:
    """Aggregate over the closure rows of one certificate, with `_known` set where the ancestor has a certificate."""
    cyclic = F.max((F.col("depth") > 0) & (F.col("id") == F.col("ancestor")))
    return (F.when(F.count_if(F.col("_known").isNull()) > 0, F.lit("UNKNOWN_CERTIFICATE"))
             .when(cyclic | (F.max("depth") >= max_depth), F.lit("INVALID_PARENT_GRAPH")).otherwise(F.lit("OK")))


def graph_problems(closure: DataFrame, nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Certificates with a cycle, an overlong chain or an unknown ancestor."""
    known = nodes.select(F.col("id").alias("ancestor"), F.lit(True).alias("_known"))
    return closure.join(known, "ancestor", "left").groupBy("id").agg(
        F.max("depth").alias("depth"), F.max((F.col("depth") > 0) & (F.col("id") == F.col("ancestor"))).alias("cyclic"),
        F.count_if(F.col("_known").isNull()).alias("unknown_parents"), graph_status(max_depth).alias("status"))


def folded(nodes: DataFrame, edges: DataFrame, merges: Mapping[str, Column] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, graph_status, *merges): what the certificates of an id and all its ancestors merge to, without the pairs of the closure.

    `merges` are aggregates over columns of `nodes` for which repeated rows change nothing (largest, least, any, intersection, union). A round adds
    what the parents know, one row per certificate and edge. A sound graph has no way of max_depth, so its merges are whole after as many rounds;
    where the status is not OK only the status is (further rounds follow until unknown ancestors have reached all that descend from them).
    """
    merges = dict(merges or {})
    links = materialize(edges.select("child", "parent").distinct())
    state = materialize(nodes.select("id", F.lit(True).alias("_own"), F.lit(0).alias("_depth"), F.lit(False).alias("_unknown"), *merges))
    known = None
    while True:
        parents = state.select(F.col("id").alias("parent"), *[c for c in state.columns if c != "id"])
        above = links.join(parents, "parent", "left").select(
            F.col("child").alias("id"), F.lit(False).alias("_own"), F.least(F.coalesce("_depth", F.lit(0)) + 1, F.lit(max_depth)).alias("_depth"),
            (F.coalesce("_unknown", F.lit(False)) | ~F.coalesce("_own", F.lit(False))).alias("_unknown"), *merges)
        state = materialize(state.unionByName(above).groupBy("id").agg(
            F.max("_own").alias("_own"), F.max("_depth").alias("_depth"), F.max("_unknown").alias("_unknown"), *[merge.alias(name) for name, merge in merges.items()]))
        now = tuple(state.agg(F.count(F.lit(1)), F.sum("_depth"), F.count_if("_unknown")).first())
        if now == known:
            break
        known = now
    status = F.when(F.col("_unknown"), F.lit("UNKNOWN_CERTIFICATE")).when(F.col("_depth") >= max_depth, F.lit("INVALID_PARENT_GRAPH")).otherwise(F.lit("OK"))
    return state.select("id", status.alias("graph_status"), *merges)


def united(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def folded_scope(certificates: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """`effective_scope` without the closure."""
    rows = certificates.withColumns({"instruments": F.array("instrument"), "partitions": F.array("partition")})
    least, most = ("period_to", "valid_to"), ("period_from", "valid_from", "revoked")
    return folded(rows, edges, {c: F.array_sort(common(c)) for c in SETS} | {c: united(c) for c in ("instruments", "partitions")}
                  | {c: F.min(c) for c in least} | {c: F.max(c) for c in most}, max_depth)


def common(column: str) -> Column:
    """Intersection of a string array over a group: members counted as often as there are rows.

    The aggregate keeps one counter per distinct name; name sets come from closed vocabularies.
    """
    return F.reduce(F.collect_set(column), F.first(column, ignorenulls=True), lambda a, x: F.array_intersect(a, x))


def effective_scope(closure: DataFrame, certificates: DataFrame) -> DataFrame:
    """What a certificate may really grant: the intersection over itself and all its ancestors, and whether they are sound.

    Ancestors without a certificate stay in, so that `graph_status` shows them.
    """
    rows = closure.join(certificates.withColumnRenamed("id", "ancestor").withColumn("_known", F.lit(True)), "ancestor", "left")
    return rows.groupBy("id").agg(
        graph_status().alias("graph_status"),
        *[common(c).alias(c) for c in SETS], F.collect_set("instrument").alias("instruments"), F.collect_set("partition").alias("partitions"),
        F.max("period_from").alias("period_from"), F.min("period_to").alias("period_to"), F.max("valid_from").alias("valid_from"),
        F.min("valid_to").alias("valid_to"), F.max("revoked").alias("revoked"))


def authorize(requests: DataFrame, scopes: DataFrame, capability_purpose: Mapping[str, str], now: Column) -> DataFrame:
    """ALLOW or DENY with the first failing reason, in a fixed order of checks.

    Ancestries are folded into one scope row per certificate first, so each request meets one row.
    """
    purpose_of = F.create_map(*[F.lit(x) for pair in capability_purpose.items() for x in pair])
    s = scopes.select(F.col("id").alias("certificate"), *[F.col(c).alias(f"_s_{c}") for c in scopes.columns if c != "id"])
    j = requests.join(s, "certificate", "left")
    missing_fields = F.size(F.array_except("fields", "_s_fields")) == 0
    inside = (F.col("_s_period_from") <= F.col("period_from")) & (F.col("period_to") <= F.col("_s_period_to"))
    checks = [
        ("UNKNOWN_CERTIFICATE", F.col("_s_graph_status") != "UNKNOWN_CERTIFICATE"), ("INVALID_PARENT_GRAPH", F.col("_s_graph_status") != "INVALID_PARENT_GRAPH"), ("REVOKED_CERTIFICATE", ~F.col("_s_revoked")),
        ("NOT_YET_VALID", now >= F.col("_s_valid_from")), ("EXPIRED_CERTIFICATE", now < F.col("_s_valid_to")),
        ("CAPABILITY_NOT_CERTIFIED", F.array_contains("_s_capabilities", F.col("capability"))),
        ("PURPOSE_DENIED", (F.col("purpose") == F.element_at(purpose_of, F.col("capability"))) & F.array_contains("_s_purposes", F.col("purpose"))),
        ("CONSUMER_DENIED", F.array_contains("_s_consumers", F.col("consumer"))),
        ("INSTRUMENT_DENIED", F.col("_s_instruments") == F.array("instrument")),
        ("PARTITION_DENIED", F.col("_s_partitions") == F.array("partition")), ("FIELD_NOT_CERTIFIED", missing_fields), ("PERIOD_DENIED", inside)]
    reasons = failed_names(checks)
    out = j.withColumn("_why", reasons)
    return out.select(*requests.columns, F.when(F.size("_why") == 0, F.lit("ALLOW")).otherwise(F.lit("DENY")).alias("decision"),
                      F.when(F.size("_why") == 0, F.lit("FULL_SCOPE_VALIDATED")).otherwise(F.get("_why", 0)).alias("reason"))


# Vocabularies of a manifest: fixed values.
KINDS = ("dataset", "features", "labels", "cache", "experiences", "model")
DERIVATIONS = ("select", "union", "concat", "copy", "rename", "cache", "features", "labels", "experiences", "model")
ENVIRONMENTS = ("RESEARCH", "PAPER", "DEMO", "LIVE")
TRACK_PARTITIONS = {"A": "DEV", "B": "FORWARD_EXECUTION"}


def manifest_violations(manifests: DataFrame, capability_purpose: Mapping[str, str], capability_fields: Mapping[str, Sequence[str]], capability_track: Mapping[str, str],
                        dev_from: str, dev_to: str, forward_floor: str) -> DataFrame:
    """Every rule a manifest breaks on its own, before any ancestry is looked at: (id, violations).

    Beside the columns of a certificate: schema_version, revision, status, track, environment, revocation_status, derivation, parents
    (array<string>), and artifact_path, artifact_kind, artifact_sha256, artifact_from, artifact_to, artifact_fields.
    """
    def mapped(values: Mapping[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    def named(column: str) -> Column:
        """A set of names: at least one, none empty, padded or repeated."""
        return (F.size(column) > 0) & (F.size(F.array_distinct(column)) == F.size(column)) & F.forall(column, lambda name: (name != "") & (F.trim(name) == name))
    known = F.array(*[F.lit(c) for c in capability_purpose])
    purposes, tracks, partitions = mapped(capability_purpose), mapped(capability_track), mapped(TRACK_PARTITIONS)
    allowed = F.create_map(*[x for c, f in capability_fields.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in f]))])
    granted = F.flatten(F.transform("capabilities", lambda c: F.coalesce(F.element_at(allowed, c), F.array().cast("array<string>"))))
    bound = F.array_sort(F.array_distinct(F.transform("capabilities", lambda c: F.element_at(purposes, c))))
    root, track = F.size("parents") == 0, F.col("track")
    low, high, floor = (F.lit(x).cast("timestamp") for x in (dev_from, dev_to, forward_floor))
    checks = [
        ("UNKNOWN_MANIFEST_VERSION", F.col("schema_version") == 1), ("INVALID_IDENTIFIER", F.col("id").rlike("^SC1-[A-Za-z0-9_-]{1,80}$")),
        ("INVALID_REVISION", F.col("revision") == 1), ("NOT_SHADOW_ELIGIBLE", F.col("status") == "SHADOW_ELIGIBLE"),
        ("INVALID_NAME_SET", named("capabilities") & named("fields") & named("consumers") & named("purposes") & named("provenance")),
        ("UNKNOWN_CAPABILITY", F.size(F.array_except("capabilities", known)) == 0),
        ("CROSS_TRACK", track.isin("A", "B") & F.forall("capabilities", lambda c: F.coalesce(F.element_at(tracks, c) == track, F.lit(False)))),
        ("PARTITION_DENIED", (F.col("partition") == F.element_at(partitions, track)) & ((track != "A") | (F.col("period_from") >= low) & (F.col("period_to") <= high))),
        ("EMPTY_OR_REVERSED_INTERVAL", (F.col("period_from") < F.col("period_to")) & (F.col("valid_from") < F.col("valid_to"))),
        ("FORWARD_CANNOT_RELABEL_HISTORICAL_PARTITIONS", (track != "B") | (F.col("period_from") >= floor)),
        ("FIELD_SEMANTICS_NOT_CERTIFIED", F.size(F.array_except("fields", granted)) == 0), ("CAPABILITY_PURPOSE_MISMATCH", F.array_sort("purposes") == bound),
        ("INVALID_INSTRUMENT", F.col("instrument") != ""), ("INVALID_ENVIRONMENT", F.col("environment").isin(*ENVIRONMENTS)),
        ("CROSS_TRACK_ENVIRONMENT", (track == "A") == (F.col("environment") == "RESEARCH")), ("INVALID_REVOCATION_STATUS", F.col("revocation_status").isin("ACTIVE", "REVOKED")),
        ("INVALID_PARENTS", F.size("parents") <= MAX_PARENTS),
        ("INVALID_PARENT_REFERENCE", (F.size(F.array_distinct("parents")) == F.size("parents")) & F.forall("parents", lambda parent: parent.rlike("^SC1-[A-Za-z0-9_-]{1,80}$"))),
        ("UNKNOWN_DERIVATION", root | F.col("derivation").isin(*DERIVATIONS)),
        ("ROOTS_ARE_TRUSTED_FIXTURES_ONLY", ~root | (F.col("derivation") == "SYNTHETIC_FIXTURE") & F.forall("provenance", lambda name: name.startswith("fixture:"))),
        ("ARTIFACT_PATH_DENIED", F.col("artifact_path") == F.concat(F.lit("data/engine/shadow/"), F.col("id"), F.lit("/artifact.parquet"))),
        ("DERIVED_ARTIFACT_REQUIRES_PARENTS", F.col("artifact_kind").isin(*KINDS) & ((F.col("artifact_kind") == "dataset") | ~root)),
        ("INVALID_ARTIFACT_DIGEST", F.col("artifact_sha256").rlike("^[0-9a-f]{64}$")),
        ("ARTIFACT_EXCEEDS_SCOPE", (F.col("period_from") <= F.col("artifact_from")) & (F.col("artifact_to") <= F.col("period_to")) & (F.size(F.array_except("artifact_fields", "fields")) == 0))]
    return manifests.select("id", failed_names(checks).alias("violations"))


def derive(edges: DataFrame, certificates: DataFrame, problems: DataFrame) -> DataFrame:
    """Child scopes as intersections of their parents, in time too, with united provenance.

    Refused: more parents than MAX_PARENTS, parents whose own graph is not sound (`problems` of `graph_problems`), parents of
    different instruments or partitions, and empty intersections.
    """
    sound = problems.select(F.col("id").alias("parent"), F.col("status").alias("_status"))
    rows = edges.join(certificates.withColumnRenamed("id", "parent"), "parent", "left").join(sound, "parent", "left")
    out = rows.groupBy("child").agg(
        F.count(F.lit(1)).alias("parents"), *[F.array_sort(common(c)).alias(c) for c in SETS], F.count_distinct("instrument").alias("_i"), F.count_distinct("partition").alias("_p"),
        F.max("period_from").alias("period_from"), F.min("period_to").alias("period_to"), F.max("valid_from").alias("valid_from"), F.min("valid_to").alias("valid_to"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance")))).alias("provenance"),
        F.count_if(F.coalesce("_status", F.lit("UNKNOWN_CERTIFICATE")) == "UNKNOWN_CERTIFICATE").alias("_unknown"), F.count_if(F.col("_status") == "INVALID_PARENT_GRAPH").alias("_invalid"))
    empty = F.coalesce((F.size("capabilities") == 0) | (F.size("fields") == 0) | (F.size("purposes") == 0) | (F.size("consumers") == 0)
                       | (F.col("period_from") >= F.col("period_to")) | (F.col("valid_from") >= F.col("valid_to")), F.lit(True))
    status = (F.when(F.col("parents") > MAX_PARENTS, F.lit("INVALID_PARENTS")).when(F.col("_unknown") > 0, F.lit("UNKNOWN_CERTIFICATE")).when(F.col("_invalid") > 0, F.lit("INVALID_PARENT_GRAPH"))
               .when((F.col("_i") > 1) | (F.col("_p") > 1), F.lit("CROSS_TRACK_OR_CONTEXT_JOIN")).when(empty, F.lit("EMPTY_PERMISSION_INTERSECTION")).otherwise(F.lit("DERIVED")))
    return out.withColumn("status", status).drop("_i", "_p", "_unknown", "_invalid")


def parent_violations(edges: DataFrame, certificates: DataFrame) -> DataFrame:
    """(child, parent, violations): where a certificate grants what its parent does not."""
    child, parent = (certificates.select(*[F.col(c).alias(f"_{side}_{c}") for c in certificates.columns]) for side in ("c", "p"))
    rows = edges.join(child, F.col("child") == F.col("_c_id")).join(parent, F.col("parent") == F.col("_p_id"), "left")

    def inside(span: str) -> Column:
        return (F.col(f"_p_{span}_from") <= F.col(f"_c_{span}_from")) & (F.col(f"_c_{span}_to") <= F.col(f"_p_{span}_to"))
    checks = [("PARENT_SCOPE_MISMATCH", (F.col("_c_instrument") == F.col("_p_instrument")) & (F.col("_c_partition") == F.col("_p_partition"))),
              *[(f"DERIVATION_EXPANDS_{name.upper()}", F.size(F.array_except(f"_c_{name}", f"_p_{name}")) == 0) for name in SETS],
              ("DERIVATION_EXPANDS_PERIOD", inside("period")), ("DERIVATION_EXPANDS_VALIDITY", inside("valid")),
              ("PARENT_PROVENANCE_LOST", F.size(F.array_except("_p_provenance", "_c_provenance")) == 0)]
    unknown = F.array(F.lit("UNKNOWN_CERTIFICATE"))
    return rows.select("child", "parent", F.when(F.col("_p_id").isNull(), unknown).otherwise(failed_names(checks)).alias("violations"))


def usable_at(closure: DataFrame, certificates: DataFrame, now: Column) -> DataFrame:
    """State of each certificate at a time: an unsound graph or any revoked, expired or future ancestor disables it."""
    facts = certificates.select(F.col("id").alias("ancestor"), "revoked", "valid_from", "valid_to", F.lit(True).alias("_known"))
    facts = closure.join(facts, "ancestor", "left").groupBy("id").agg(
        graph_status().alias("_s"), F.max("revoked").alias("_r"), F.max("valid_from").alias("_f"), F.min("valid_to").alias("_t"))
    return _state(facts, now)


def folded_state(certificates: DataFrame, edges: DataFrame, now: Column, max_depth: int = MAX_DEPTH) -> DataFrame:
    """`usable_at` without the closure."""
    facts = folded(certificates, edges, {"revoked": F.max("revoked"), "valid_from": F.max("valid_from"), "valid_to": F.min("valid_to")}, max_depth)
    return _state(facts.toDF("id", "_s", "_r", "_f", "_t"), now)


def _state(facts: DataFrame, now: Column) -> DataFrame:
    return facts.select("id", F.when(F.col("_s") != "OK", F.col("_s")).when(F.col("_r"), F.lit("REVOKED_CERTIFICATE")).when(now < F.col("_f"), F.lit("NOT_YET_VALID"))
                        .when(now >= F.col("_t"), F.lit("EXPIRED_CERTIFICATE")).otherwise(F.lit("ACTIVE")).alias("state"))
