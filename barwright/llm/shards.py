"""Sharding by balanced label propagation.

Method: documents are linked through what they share, equal texts and equal lines. In every round each shared item tells its
documents which shards hold how much of it, each unit of documents names the shard where most of what it shares lies, and of
those who would move from one shard to another only as many go as come back (plus what free room allows). Then an exact levelling
step gives every shard its quota, taking unlinked documents first. All of it is joins and aggregates; shared items are
aggregated per shard before they meet their documents, so an item in a third of all rows costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barwright.session import materialize

# Rounds of propagation; shortest line, in bytes, that links; a group of equal texts moves in units of a 32nd of all rows at most.
ROUNDS, LINE_BYTES, PARTS = 4, 24, 32
# Rows that one ordering task should number.
CHUNK = 20_000
HASH_SPAN = 1 << 30


def base_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Narrow columns per row; `twin` stands for the text, `lines` for its long lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.filter(F.split(body, "\n"), lambda line: F.octet_length(line) >= LINE_BYTES), lambda line: F.xxhash64(F.lit(3), line))
    return df.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                     F.xxhash64(F.lit(1), body).alias("twin"), F.xxhash64(F.lit(2), body).alias("check"), F.array_distinct(lines).alias("lines"))


def propagate(rows: DataFrame, shards: int, rounds: int, total: int) -> tuple[DataFrame, DataFrame]:
    """(units with shard, weight and whether they are linked; rows with their unit)."""
    most = max(1, -(-total // PARTS))
    groups = rows.groupBy("twin", "check").agg(F.count(F.lit(1)).alias("copies"), F.first("lines").alias("lines"))
    # A line links where it stands in at least two different texts.
    spread = groups.select(F.explode("lines").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    pieces = F.ceil(F.col("copies") / most).cast("int")
    groups = groups.withColumn("pieces", pieces)
    holds = groups.select("twin", "check", "copies", "pieces", F.explode("lines").alias("item")).join(spread, "item").select("twin", "check", "copies", "pieces", "item")
    # A group in several pieces is linked through its own text.
    holds = holds.union(groups.where("pieces > 1").select("twin", "check", "copies", "pieces", F.xxhash64(F.lit(4), "twin", "check").alias("item")))
    one = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    links = materialize(holds.select(F.xxhash64(F.lit(5), "twin", "check").alias("unit0"), "copies", "pieces", "item", one)
                        .select(F.xxhash64("unit0", "piece").alias("unit"), (F.col("copies") / F.col("pieces")).alias("weight"), "item"))
    # Linked units start where the least of their items points, so that neighbours begin together.
    start = links.groupBy("unit").agg(F.min("item").alias("seed"), F.max("weight").alias("weight"))
    labels = start.select("unit", "weight", F.pmod(F.xxhash64(F.lit(6), "seed"), F.lit(shards)).cast("int").alias("shard"))
    for number in range(rounds):
        # One row per item: what each shard holds of it, relative to all of it, so that common lines count less.
        held = [F.sum(F.when(F.col("shard") == s, F.col("weight")).otherwise(0.0)) for s in range(shards)]
        votes = links.join(labels.select("unit", "shard"), "unit").groupBy("item").agg(F.array(*held).alias("mass"))
        votes = votes.select("item", "mass", F.aggregate("mass", F.lit(0.0), lambda total, mass: total + mass).alias("all"))
        # One row per unit: how strongly each shard pulls; of equal pulls a hash decides.
        pull = links.join(votes, "item").groupBy("unit").agg(*[F.sum(F.col("mass")[s] / F.col("all")).alias(f"pull{s}") for s in range(shards)])
        best = F.array_max(F.array(*[F.struct(F.col(f"pull{s}").alias("pull"), F.xxhash64("unit", F.lit(s)).alias("draw"), F.lit(s).alias("to")) for s in range(shards)]))
        best = pull.select("unit", best["to"].alias("to"))
        wish = materialize(labels.join(best, "unit").select("unit", "weight", "shard", "to"))
        flows = {(r["shard"], r["to"]): r["mass"] for r in wish.where("shard <> to").groupBy("shard", "to").agg(F.sum("weight").alias("mass")).collect()}
        sizes = {r["shard"]: r["mass"] for r in wish.groupBy("shard").agg(F.sum("weight").alias("mass")).collect()}
        quota = {}
        for (a, b), mass in sorted(flows.items()):
            room = max(0.0, total / shards - sizes.get(b, 0.0)) / max(1, shards - 1)
            quota[a, b] = min(1.0, (min(mass, flows.get((b, a), 0.0)) + room) / mass)
        if not quota:
            break
        # shards x shards quotas; who goes is decided by a hash, so no unit waits for another.
        allowed = F.coalesce(*[F.when((F.col("shard") == a) & (F.col("to") == b), F.lit(q)) for (a, b), q in quota.items()], F.lit(0.0))
        draw = F.pmod(F.xxhash64(F.lit(100 + number), "unit"), F.lit(HASH_SPAN)) / HASH_SPAN
        labels = wish.select("unit", "weight", F.when(draw < allowed, F.col("to")).otherwise(F.col("shard")).alias("shard"))
    unit = rows.join(groups.where("pieces > 1").select("twin", "check", "pieces"), ["twin", "check"], "left") if total > PARTS else rows.withColumn("pieces", F.lit(None).cast("int"))
    piece = F.pmod(F.xxhash64(F.lit(7), "_key"), F.coalesce("pieces", F.lit(1))).cast("int")
    unit = unit.select("_key", "size", "text_crc32", "twin", F.xxhash64(F.xxhash64(F.lit(5), "twin", "check"), piece).alias("unit"))
    return labels.select("unit", F.col("shard").alias("_shard")), unit


def assign(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Law `rows`: counts of any two shards differ by one at most. One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots are gapless from 0 in each shard. Null texts are empty (size 1); null keys and repeated rows are rows like others; an
    empty table gives no rows; extra columns are not read.
    """
    rows = materialize(base_rows(df, key, text))
    total = rows.count()
    labels, units = propagate(rows, shards, rounds, total)
    copies = rows.groupBy("twin").agg(F.count(F.lit(1)).alias("twins"))
    placed = units.join(labels, "unit", "left").join(copies.where("twins > 1"), "twin", "left")
    # Unlinked documents fill up: copies by their text, the others anywhere. They come last, so levelling takes them first.
    alone = F.when(F.col("_shard").isNotNull() | F.col("twins").isNotNull(), 0).otherwise(1)
    shard = F.coalesce("_shard", F.pmod(F.xxhash64(F.lit(8), "unit"), F.lit(shards)).cast("int"))
    chunks = max(1, total // (CHUNK * shards))
    # Copies stay side by side, but a text of many copies is numbered by several tasks.
    spread = F.when(F.col("twins") > CHUNK, F.pmod(F.xxhash64(F.lit(9), "_key"), F.ceil(F.col("twins") / CHUNK))).otherwise(0)
    chunk = F.pmod(F.xxhash64(F.lit(10), "unit", spread), F.lit(chunks)).cast("int")
    placed = materialize(placed.select("_key", "size", "text_crc32", "unit", shard.alias("_shard"), alone.alias("_alone"), chunk.alias("_chunk")))
    counts = materialize(placed.groupBy("_shard", "_alone", "_chunk").agg(F.count(F.lit(1)).alias("n")))
    # One row per shard and chunk, so a window over a shard orders rows / CHUNK of them.
    offsets = counts.select("_shard", "_alone", "_chunk", F.coalesce(F.sum("n").over(Window.partitionBy("_shard").orderBy("_alone", "_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    found = {r["_shard"]: r["n"] for r in counts.groupBy("_shard").agg(F.sum("n").alias("n")).collect()}
    held, quota = [found.get(s, 0) for s in range(shards)], [total // shards + (s < total % shards) for s in range(shards)]
    surplus, room, gone, filled = [], [], 0, 0
    for s in range(shards):
        surplus.append(gone)
        gone += max(0, held[s] - quota[s])
        if held[s] < quota[s]:
            room.append((filled, s, held[s]))
            filled += quota[s] - held[s]
    order = Window.partitionBy("_shard", "_alone", "_chunk").orderBy("unit", "_key", "size", "text_crc32")
    numbered = placed.withColumn("_n", F.row_number().over(order) - 1).join(offsets, ["_shard", "_alone", "_chunk"]).withColumn("_at", F.col("_before") + F.col("_n"))
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("_shard") + 1)
    moved = F.col("_at") >= limit
    number = F.element_at(F.array(*[F.lit(x) for x in surplus]), F.col("_shard") + 1) + F.col("_at") - limit
    to, slot = F.lit(0), F.lit(0)
    for first, s, start in room:
        to, slot = F.when(number >= first, s).otherwise(to), F.when(number >= first, number - first + start).otherwise(slot)
    return numbered.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), F.when(moved, to).otherwise(F.col("_shard")).cast("int").alias("shard"),
                           F.when(moved, slot).otherwise(F.col("_at")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
