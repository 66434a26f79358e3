"""Sharding by balanced label propagation, in DataFrame functions only.

Documents of equal text are linked (each group is a hub with its copies). A link
between documents of different shards is a cut edge. Labels (shards) spread
along the links under capacity quotas until few edges are cut, and the result
has row counts at most one apart (law `rows`).

Unit of movement: the copies of one text that share a hash of their id, at most
`LANES` units to a group, so that a group that holds a third of all rows is
spread over that many keys in every join, and can be divided among shards.

A round: every group votes for the shard that holds most of it; its other units
propose to move there. Proposals are pre-aggregated by (from, to, gain and group
bucket), a table of bounded size, and accepted up to a quota for each pair of
shards: the smaller of the two opposite flows, which swaps, plus a share of the
room left in the target. Each round is cut by a checkpoint. Rounds go on while
they bring the rows outside their group's shard down by SETTLED or more, so that
they end whatever the table; `max_rounds` may end them earlier.

While labels move, a shard may exceed an even share by SLACK. Exact sizes: then
linked documents keep their place up to the shard's quota of rows; the others
and the unlinked documents fill the gaps in order of their group, so that few
groups are cut. Ranks come from counts of buckets (bounded tables) and a window
within each bucket, never from one window over a shard or over everything.

Defined results: a null text counts as the empty text, of size 8; repeated rows
are rows of their own and get slots of their own, in whatever order; fewer rows
than shards leave shards empty; an empty table gives no rows; a text of any
length is hashed whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.session import cut

SHARDS = 24
#: Units of a group; also the spread of a hot group over keys.
LANES = 384
#: Buckets of groups in which proposals are accepted together, by pair of shards.
FLOW_BUCKETS = 64
#: Buckets of groups and of ids within a group for ranks.
GROUP_BUCKETS, ID_BUCKETS = 128, 16
#: Rows of a group that one bucket holds at least.
LARGE = 1000
#: Share by which a shard may exceed an even one while labels move; the last step makes it even.
SLACK = 0.5
#: Least share by which a round has to lessen the rows outside their group's shard for another one to follow.
SETTLED = 0.01


def _ranked(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """rows with `rank`, from 0 and gapless within `within`, in the order of (gb, ib, *order).

    rows has bucket columns gb and ib; the counts of buckets are a table of at
    most GROUP_BUCKETS * ID_BUCKETS rows for each value of `within`.
    """
    keys = [*within, "gb", "ib"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*within).orderBy("gb", "ib").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(inside))
    return placed.join(offsets, keys).withColumn("rank", F.col("offset") + F.col("place") - 1).drop("offset", "place")


def propagate(units: DataFrame, shards: int, capacity: int, max_rounds: int | None = None) -> DataFrame:
    """units (g, lane, n, label) with labels moved along links under quotas.

    A label takes rows up to about `capacity`; balanced_shards() evens the rest.
    """
    before, rounds = None, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        cells = units.groupBy("g", "label").agg(F.sum("n").alias("held"))
        turn = F.pmod(F.col("label") - F.pmod("g", F.lit(shards)), F.lit(shards))
        best = cells.groupBy("g").agg(
            F.max(F.struct(F.col("held"), (-turn).alias("turn"), F.col("label").alias("goal"))).alias("best")
        ).select("g", F.col("best.goal").alias("goal"), F.col("best.held").alias("at_goal"))
        gain = F.least(F.lit(15), F.floor(F.log2(F.col("at_goal") + 1))).cast("int")
        # Larger groups first, then by a hash of the group, which keeps a group together.
        bucket = (15 - gain) * FLOW_BUCKETS + F.pmod(F.xxhash64("g"), F.lit(FLOW_BUCKETS))
        asked = units.join(best, "g").select("g", "lane", "n", "label", "goal", F.when(F.col("label") != F.col("goal"), bucket).alias("bucket"))
        asked = cut(asked)
        away = asked.where("bucket is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if away == 0 or (before is not None and away > (1 - SETTLED) * before):
            break
        before = away
        flows = asked.where("bucket is not null").groupBy("label", "goal", "bucket").agg(F.sum("n").alias("n"))
        pairs = flows.groupBy("label", "goal").agg(F.sum("n").alias("flow"))
        back = pairs.select(F.col("label").alias("goal"), F.col("goal").alias("label"), F.col("flow").alias("back"))
        loads = asked.groupBy("label").agg(F.sum("n").alias("load")).withColumnRenamed("label", "goal")
        into = pairs.groupBy("goal").agg(F.sum("flow").alias("into"))
        room = F.greatest(F.lit(0), F.lit(capacity) - F.coalesce("load", F.lit(0)))
        quotas = (
            pairs.join(back, ["label", "goal"], "left").join(into, "goal").join(loads, "goal", "left")
            .select("label", "goal", (F.least("flow", F.coalesce("back", F.lit(0))) + F.floor(room * F.col("flow") / F.col("into"))).alias("quota"))
        )
        running = Window.partitionBy("label", "goal").orderBy("bucket")
        accepted = (
            flows.withColumn("sum", F.sum("n").over(running)).join(quotas, ["label", "goal"])
            .where("sum <= quota").groupBy("label", "goal").agg(F.max("bucket").alias("upto"))
        )
        # At most shards * (shards - 1) rows.
        moved = asked.join(F.broadcast(accepted), ["label", "goal"], "left")
        moves = F.col("bucket").isNotNull() & (F.col("bucket") <= F.col("upto"))
        units = cut(moved.select("g", "lane", "n", F.when(moves, F.col("goal")).otherwise(F.col("label")).alias("label")))
    return units.select("g", "lane", "n", "label")


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, max_rounds: int | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless from 0 in its shard)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = cut(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("crc"),
            F.xxhash64(text).alias("g"),
            F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(LANES)).cast("int").alias("lane"),
        )
    )
    total = base.count()
    units = base.groupBy("g", "lane").agg(F.count("*").alias("n"))
    linked = units.groupBy("g").agg(F.sum("n").alias("rows")).where("rows > 1")
    start = cut(units.join(linked, "g").select("g", "lane", "n", "rows", F.pmod("lane", F.lit(shards)).alias("label")))
    labels = propagate(start.drop("rows"), shards, int((1 + SLACK) * -(-total // shards)), max_rounds)
    large = F.col("rows") > max(LARGE, total // (GROUP_BUCKETS * ID_BUCKETS))
    labels = labels.join(start.select("g", "lane", large.alias("large")), ["g", "lane"])

    # A group lies in one bucket, so that a border cuts one group; a large one in many neighbouring buckets.
    near = F.when(F.col("large"), F.floor(F.col("lane") / 48)).otherwise(0)
    hashed = F.pmod(F.xxhash64("g", F.lit(1)) + near, F.lit(GROUP_BUCKETS)).alias("gb")
    spread = F.when(F.col("large"), F.pmod("lane", F.lit(ID_BUCKETS))).otherwise(F.pmod(F.xxhash64("g", F.lit(2)), F.lit(ID_BUCKETS))).alias("ib")
    placed = base.join(labels.select("g", "lane", "label", "large"), ["g", "lane"], "left").select("id", "size", "crc", "g", "label", hashed, spread)

    # Shard k gets one row more than the others while rows are left over.
    quota = F.lit(total // shards) + F.when(F.col("label") < total % shards, 1).otherwise(0)
    order = ["g", "id", "crc"]
    sitting = cut(_ranked(placed.where("label is not null"), ["label"], order).withColumn("stays", F.col("rank") < quota))
    stay = sitting.where("stays").select("id", "size", "crc", F.col("label").alias("shard"), F.col("rank").alias("slot"))
    rest = placed.where("label is null").drop("label").unionByName(sitting.where("not stays").drop("label", "rank", "stays"))

    taken = {row["shard"]: row["n"] for row in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    bounds, filled = [], 0
    for k in range(shards):
        bounds.append(filled)
        filled += total // shards + (k < total % shards) - taken.get(k, 0)
    # The last shard that starts at or before the rank; shards without a gap start where the next one does.
    starts = F.array(*[F.lit(b).cast("long") for b in bounds])
    shard = (F.size(F.filter(starts, lambda b: b <= F.col("rank"))) - 1).cast("int")
    held = F.array(*[F.lit(taken.get(k, 0)).cast("long") for k in range(shards)])
    fill = _ranked(rest.withColumn("all", F.lit(0)), ["all"], order).withColumn("shard", shard)
    fill = fill.select("id", "size", "crc", "shard", (F.col("rank") - F.get(starts, F.col("shard")) + F.get(held, F.col("shard"))).alias("slot"))
    return stay.unionByName(fill).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def digest(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """balanced_shards() with the law it keeps."""
    return placed.select(F.col(f"`{id_col}`"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(placed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kept, total: links of equal texts inside one shard, and all of them (from counts, not pairs).

    placed: id and shard; docs: the documents, each id once.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("g"))
    cells = placed.select(F.col(f"`{id_col}`").alias("id"), "shard").join(texts, "id").groupBy("g", "shard").agg(F.count("*").alias("n"))
    links = lambda n: F.sum(n * (n - 1) / 2).cast("long")
    groups = cells.groupBy("g").agg(F.sum("n").alias("rows"), links(F.col("n")).alias("kept"))
    return groups.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(links(F.col("rows")), F.lit(0)).alias("total"))


def brute_force(groups: list[int], shards: int) -> int:
    """The most links that any division of groups of these sizes into even shards keeps, by trying all; for tests."""
    total = sum(groups)
    quotas = tuple(sorted(total // shards + (k < total % shards) for k in range(shards)))

    def best(at: int, room: tuple[int, ...], known: dict) -> int:
        if at == len(groups):
            return 0
        if (at, room) not in known:
            known[at, room] = max(kept + best(at + 1, tuple(sorted(left)), known) for kept, left in _divisions(groups[at], room))
        return known[at, room]

    return best(0, quotas, {})


def _divisions(size: int, room: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
    """Links kept and room left for every way to deal `size` copies out to shards."""
    if not room:
        return [(0, ())] if size == 0 else []
    return [(n * (n - 1) // 2 + kept, (room[0] - n, *left)) for n in range(min(size, room[0]) + 1) for kept, left in _divisions(size - n, room[1:])]
