"""Sharding by balanced label propagation: equal texts move to one shard under quotas.

Documents start in a shard dealt by a hash of their id. In each round every group of
equal texts names the shard that holds most of it and has room, and its other members
ask to move there; those of a group too large for it go to further shards in later
rounds. A shard admits as many rows as its quota has room for; who is admitted is read
from a bounded table of counts by shard, strength of the pull and hash bucket, so no
task ever ranks all rows. At the end surplus rows, those without links first, fill the
free places, which makes the counts differ by one at most.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

SHARDS = 16
LARGE = 1000  # a group with more than this part of all rows is large, so fewer than LARGE are
BUCKETS = 512  # hash buckets in which a shard's applicants are counted
PULLS = 8  # classes of strength, by powers of two of the members already there


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``number``: 0, 1, 2 … within ``by``, without a task that sees a whole shard.

    Rows are counted in parts (column ``part`` comes first in the order), and a row's
    number is the count of the earlier parts plus its place in its own. The table of
    counts has a row per shard and part, whatever the number of rows.
    """
    counts = rows.groupBy(*by, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    place = Window.partitionBy(*by, "part").orderBy(*order)
    ranked = rows.withColumn("place", F.row_number().over(place) - 1)
    return (
        ranked.join(F.broadcast(offsets), [*by, "part"])
        .withColumn("number", (F.col("before") + F.col("place")).cast("long"))
        .drop("before", "place", "part")
    )


def propagate(nodes: DataFrame, room: dict[int, int], turn: int = 0) -> DataFrame:
    """One round: linked ``nodes`` with new shards; ``room`` is what each shard may admit.

    Column ``moved`` tells which rows changed; ``turn`` deals the buckets anew.

    Members ask to move to the shard that holds most of their group among those with
    room for all of it; where none has, to the one that holds most among those with any
    room. There only members on shards that hold less of the group ask, so full shards
    keep theirs.
    """
    limits = F.create_map(*[F.lit(int(x)) for pair in sorted(room.items()) for x in pair])
    held = nodes.groupBy("grp", "shard", "large").agg(F.count("*").alias("n"))
    group = Window.partitionBy("grp")  # a row per shard at most
    # A shard that can take the whole group comes before one that cannot.
    fits = limits[F.col("shard")] >= F.sum("n").over(group) - F.col("n")
    open_ = limits[F.col("shard")] > 0
    rank = F.struct(F.col("fits"), F.col("open"), F.col("n").alias("n"), (-F.col("shard")).alias("s"))
    pulls = (
        held.withColumn("fits", fits).withColumn("open", open_).withColumn("best", F.max(rank).over(group))
        .withColumn("target", -F.col("best.s"))
        .filter("shard != target and best.open")
        # Along this order no two shards can send members to and fro.
        .filter(F.col("best.fits") | (
            F.struct(F.col("n"), -F.col("shard")) < F.struct(F.col("best.n"), F.col("best.s"))
        ))
        .select(
            "grp", "shard", "large", "target", F.col("best.fits").alias("whole"),
            F.least(F.log2(F.col("best.n")).cast("int"), F.lit(PULLS - 1)).alias("pull"),
        )
    )
    # A group that fits applies as one; of a larger one rows apply by themselves.
    met = by_group(nodes, pulls, ["target", "whole", "pull"], ["shard"])
    asked = met.withColumn(
        "bucket",
        F.pmod(
            F.when(F.col("whole"), F.xxhash64("grp", F.lit(turn)))
            .otherwise(F.xxhash64("h", "uid", F.lit(turn))),
            F.lit(BUCKETS),
        ).cast("int"),
    )
    # Applicants by shard, strength and bucket: at most shards x PULLS x 2 x BUCKETS rows.
    keys = ["target", "pull", "whole", "bucket"]
    counted = asked.filter("target is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    queue = Window.partitionBy("target").orderBy(F.desc("pull"), F.desc("whole"), "bucket")
    admitted = (
        counted.withColumn("upto", F.sum("n").over(queue))
        .withColumn("free", limits[F.col("target")] - F.col("upto") + F.col("n"))
        .withColumn("split", F.col("free") < F.col("n"))
        .filter("free > 0 and not (whole and split)").select(*keys, "free", "split")
    )
    placed = asked.join(F.broadcast(admitted), keys, "left")
    # The one bucket of single rows that only partly fits is ranked, so a shard gets full.
    place = Window.partitionBy(*keys).orderBy("h", "uid")
    partly = placed.filter("split").withColumn("goes", F.row_number().over(place) <= F.col("free"))
    rest = placed.filter("not coalesce(split, false)").withColumn("goes", F.isnotnull("free"))
    return rest.unionByName(partly).select(
        *[c for c in nodes.columns if c not in ("shard", "moved")],
        F.when(F.col("goes"), F.col("target")).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.col("goes").alias("moved"),
    )


def by_group(rows: DataFrame, facts: DataFrame, names: list[str], more: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of ``facts``, of equal ``grp`` and ``more`` (or null).

    Both have the flag ``large``. The facts of large groups are broadcast, as such groups
    are fewer than ``LARGE``; any other group is small enough for one task, and the rows of
    large ones go through that join under a key of their own, dealt evenly.
    """
    def named(which: str, mark: str, key: str) -> DataFrame:
        found = facts.filter(which)
        return found.select(F.col("grp").alias(key), *more, *[F.col(c).alias(mark + c) for c in names])

    alone = F.encode(F.col("uid").cast("string"), "utf-8")
    keyed = rows.withColumn("key", F.when(F.col("large"), alone).otherwise(F.col("grp")))
    few = F.broadcast(named("large", "few_", "grp"))
    both = keyed.join(few, ["grp", *more], "left").join(
        named("not large", "one_", "key"), ["key", *more], "left"
    )
    return both.select(
        *rows.columns,
        *[F.when(F.col("large"), F.col(f"few_{c}")).otherwise(F.col(f"one_{c}")).alias(c) for c in names],
    )


def linked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``large`` and ``loose``, which is 1 where no other row has the ``grp``."""
    copies = rows.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1")
    copies = copies.select("grp", (F.col("n") * LARGE > rows.count()).alias("large"), F.lit(0).alias("found"))
    names = F.broadcast(copies.filter("large").select("grp", "large"))
    flagged = rows.join(names, "grp", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    found = by_group(flagged, copies, ["found"], [])
    return found.withColumn("loose", F.coalesce("found", F.lit(1))).drop("found")


def shard(docs: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """Place each row of ``docs(doc_id, text)`` into one of ``shards`` shards.

    Law ``rows``: the shards' counts differ by one at most. Groups are rows with equal
    text (null counts as the empty text); a group stays together unless the quota
    splits it. Rounds go on until no row moves: a group that fits moves at once and for
    good, and any other move goes to a shard that holds at least as much of the group, so
    the sum of squares of a group's holdings grows with it and has a bound. Returns ``doc_id``, ``size`` (UTF-8 bytes plus one), ``text_crc32``,
    ``law``, ``shard``, ``slot`` (gapless from 0) and ``grown_shard`` (null). Repeated
    rows are placed each, long texts count by their hash and length only, fewer rows than shards leave shards empty, an empty table
    gives no rows, and extra columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = staged(rows.withColumn("h", F.xxhash64("id", "grp")), "shard-rows")
    start = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    placed = staged(linked(start), "shard-start")
    counts = by_shard(placed)
    total = sum(counts.values())
    fixed = by_shard(placed.filter("loose = 1"))
    nodes = placed.filter("loose = 0")
    now = by_shard(nodes)
    for turn in count():
        # Rows without links give way, so only linked ones use up a quota.
        room = {s: max(0, total // shards - now.get(s, 0)) for s in range(shards)}
        nodes = staged(propagate(nodes, room, turn), "shard-round")
        now = by_shard(nodes)
        if nodes.filter("moved").isEmpty():
            break
    nodes = nodes.drop("moved")
    counts = {s: fixed.get(s, 0) + now.get(s, 0) for s in range(shards)}
    placed = nodes.unionByName(placed.filter("loose = 1"))

    # Exact quotas: places beyond a shard's quota are surplus and fill the free places.
    parts = max(1, shuffle_partitions(spark) // 4)
    part = F.col("loose") * parts + F.pmod(F.xxhash64("h", "uid"), F.lit(parts))
    ranked = numbered(placed.withColumn("part", part), ["shard"], ["h", "uid"])
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    surplus, place, free = F.lit(None).cast("long"), 0, []
    for s in range(shards):
        over = max(0, counts.get(s, 0) - quota[s])
        if over:
            rank = F.col("number") - quota[s] + place
            beyond = (F.col("shard") == s) & (F.col("number") >= quota[s])
            surplus = F.when(beyond, rank).otherwise(surplus)
        place += over
    taken = 0
    for s in range(shards):
        room = max(0, quota[s] - counts.get(s, 0))
        if room:
            free.append((s, taken, taken + room, counts.get(s, 0) - taken))
        taken += room
    new_shard, new_slot = F.col("shard"), F.col("number")
    for s, begin, end, shift in free:
        inside = (F.col("surplus") >= begin) & (F.col("surplus") < end)
        new_shard = F.when(inside, F.lit(s)).otherwise(new_shard)
        new_slot = F.when(inside, F.col("surplus") + shift).otherwise(new_slot)
    return ranked.withColumn("surplus", surplus).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"), new_shard.cast("int").alias("shard"),
        new_slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def by_shard(rows: DataFrame) -> dict[int, int]:
    """Rows per shard: one short row per shard reaches the driver."""
    return dict(rows.groupBy("shard").count().collect())
