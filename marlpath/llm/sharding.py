"""Balanced label propagation: linked documents drift into one shard while all shards keep the same number of rows.

DataFrame operations only. Links are given as hubs: rows with one hub are linked with each other (a star through the
hub, never pairs). A hub larger than a shard is parted into hubs of a shard's size. Hubs of over an eighth of a shard, of
which there are few, are placed first, whole; the others are propagated in the room that these leave, where no hub is large
against a shard's quota. Rows without links are not propagated; they level the shards at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import gapless_rank, pinned, released

PACKETS = 256


def places_of_large(sizes: list[tuple[str, int]], shards: int, quota: int) -> tuple[list[tuple[str, int, int | None]], list[int]]:
    """((hub, part, shard) of each part of ``quota`` rows at most, largest first to the emptiest shard; shard is None where no shard has room), and the rows placed in each shard."""
    parts = [(min(quota, n - first), hub, first // quota) for hub, n in sizes for first in range(0, n, quota)]
    held, found = [0] * shards, []
    for n, hub, part in sorted(parts, key=lambda p: (-p[0], p[1], p[2])):
        shard = min(range(shards), key=held.__getitem__)
        if held[shard] + n <= quota:
            held[shard] += n
            found.append((hub, part, shard))
        else:
            found.append((hub, part, None))
    return found, held


def of_label(numbers: list[int], label: str) -> Column:
    """The number of a row's shard."""
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in numbers]), F.col(label) + 1)


def propagate(linked: DataFrame, room: list[int], rounds: int = 6) -> DataFrame:
    """(rid, hub, label) after at most ``rounds`` rounds, from (rid, hub) and hashed first labels, for shards with ``room`` for so many rows.

    In a round each row prefers the label with most rows of its hub. Moves go in packets: of the rows that want into a
    shard, whole packets (by a hash of the hub, so that a hub moves as one) are let in while the shard's
    room lasts, counted with the rows that stay there. Hubs that were refused vote on, among shards with room.
    """
    before = [sum(room[: k + 1]) for k in range(len(room))]
    turn_of = F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(before[-1]))
    first = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in before]), lambda x: x <= turn_of))
    now = pinned(linked.withColumn("label", first.cast("int")), "labels")
    quota = of_label(room, "label")
    for turn in range(rounds):
        loads = now.groupBy("label").agg(F.count(F.lit(1)).alias("load"))
        votes = now.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
        known = votes.join(F.broadcast(loads), "label")  # loads has one row a shard
        weight = F.col("n") - F.when(F.col("load") >= quota, F.least(F.col("load") - quota + 1, F.lit(turn) * F.col("n"))).otherwise(0)
        best = known.groupBy("hub").agg(F.max_by("label", F.struct(weight, F.xxhash64("hub", "label"))).alias("want"))
        wishes = now.join(best, "hub")
        packet = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(PACKETS))
        flow = wishes.groupBy("want", packet.alias("packet")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("want")).alias("moving")
        )
        so_far = Window.partitionBy("want").orderBy(F.col("moving") > 0, "packet").rowsBetween(Window.unboundedPreceding, 0)
        let_in = flow.withColumn("sum", F.sum("n").over(so_far)).where(F.col("sum") <= of_label(room, "want")).select("want", "packet", F.lit(True).alias("ok"))
        moved = (
            wishes.withColumn("packet", packet)
            .join(F.broadcast(let_in), ["want", "packet"], "left")  # at most PACKETS rows a shard
            .select("rid", "hub", F.when(F.col("ok"), F.col("want")).otherwise(F.col("label")).alias("label"), F.col("label").alias("was"))
        )
        moved = pinned(moved, "labels")
        released(moved.sparkSession, now)
        now = moved.drop("was")
        if moved.where("label <> was").isEmpty():
            break
    return now


def numbered(rows: DataFrame) -> DataFrame:
    """Adds rid, a 128-bit hash of id, text and which of the repeated rows it is: the same for any order of the rows, as equal rows are alike."""
    copy = F.lit(0)
    if not rows.groupBy("id", "hub").count().where("count > 1").isEmpty():
        rows = pinned(rows.withColumn("_at", F.monotonically_increasing_id()), "rows")
        rows, copy = gapless_rank(rows, ["id", "hub"], [F.col("_at")], "_copy"), F.col("_copy")
    name = F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("-")), F.lit("|"), "hub", F.lit("|"), copy.cast("string"))
    return rows.withColumn("rid", F.unhex(F.md5(name.cast("binary")))).drop("_at", "_copy")


def shard_rows(
    docs: DataFrame, shards: int = 24, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null).

    Sizes of shards differ by one row at most. Equal texts are linked, and share a shard where quotas allow; a text
    with more copies than a shard has rows fills whole shards. size: UTF-8 bytes plus 8. A null text
    has no bytes, checksum 0, and is linked with empty ones. Repeated rows are rows like others; null ids are
    allowed. Fewer rows than shards leave shards empty. Slots are gapless from 0 in each shard, in hash order. The
    result doesn't depend on how the rows lie in files.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("hub"),
    )
    rows = pinned(numbered(pinned(rows, "rows")), "rows")
    n = rows.count()
    quota = n // shards
    small = max(1, quota // 8)
    sizes = pinned(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    linked = rows.select("rid", "hub").join(sizes, "hub")
    moving = linked.where(F.col("n") <= small).select("rid", F.xxhash64("hub", F.lit(-1)).alias("hub"))
    fixed, room = None, [quota] * shards
    # all rows / small bounds the number of large hubs: about 8 times that of shards
    large = [(r["hub"], r["n"]) for r in sizes.where(F.col("n") > small).collect()] if quota else []
    if large:
        places, held = places_of_large(large, shards, quota)
        room = [quota - x for x in held]
        table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', {p}, {'CAST(NULL AS INT)' if s is None else s})" for h, p, s in places) + " AS t(hub, part, shard)")
        ranked = gapless_rank(linked.where(F.col("n") > small), ["hub"], [F.col("rid")], "place").withColumn("part", F.floor(F.col("place") / quota).cast("int"))
        placed = pinned(ranked.join(F.broadcast(table), ["hub", "part"]).select("rid", "hub", "place", "shard"), "large")
        fixed = placed.where("shard is not null").select("rid", "shard")
        moving = moving.union(placed.where("shard is null").select("rid", F.xxhash64("hub", F.floor(F.col("place") / small)).alias("hub")))
    moving = pinned(moving, "hubs")
    if sum(room):
        settled = propagate(moving, room, rounds)
    else:  # fewer rows than shards, or nothing left beside the large hubs
        settled = moving.withColumn("label", F.pmod("hub", F.lit(shards)).cast("int"))

    wanted = F.lit(quota).cast("long") + F.when(F.col("shard") < n % shards, 1).otherwise(0)
    left = wanted - of_label([quota - r for r in room], "shard")
    ranked = gapless_rank(settled.withColumnRenamed("label", "shard"), ["shard"], [F.col("hub"), F.col("rid")], "place")
    stay = ranked.where(F.col("place") < left).select("rid", "shard")
    stay = pinned(stay.union(fixed) if fixed is not None else stay, "stay")
    held = stay.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    gaps = (
        spark.range(shards).select(F.col("id").cast("int").alias("shard"))
        .join(F.broadcast(held), "shard", "left")
        .withColumn("gap", wanted - F.coalesce("held", F.lit(0)))
        .withColumn("lo", F.coalesce(F.sum("gap").over(before), F.lit(0)))
        .select("shard", "lo", (F.col("lo") + F.col("gap")).alias("hi"))
    )
    loose = gapless_rank(rows.select("rid").join(stay, "rid", "left_anti"), [], [F.col("rid")], "place")
    filled = loose.join(F.broadcast(gaps), (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select("rid", "shard")
    placed = rows.join(stay.union(filled), "rid")
    slotted = gapless_rank(placed, ["shard"], [F.col("rid")], "slot")
    return slotted.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
