"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Native DataFrame and SQL functions throughout. Every shard has `replicas` points on
a ring of 2**60 places; a key belongs to the first point clockwise. Loads are
bounded: taking the arcs clockwise from place 0 and the keys of an arc by place, a
key goes to its own shard while that has room and otherwise on to the next shard
clockwise that has. With no slack the limits add up to the number of rows, so the
counts are at most one apart.

Only numbers per arc decide who overflows. They are counted with map-side combining
and folded in one expression over shards * replicas arcs (a fixed bound); the result,
at most one piece per arc and one more per shard that fills up, is broadcast. Ranks
of keys on an arc come from counts of small place ranges, so no window spans an arc,
and equal rows are counted before anything is shuffled.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm.common import stored

RING_BITS = 60
CELL_BITS = 12


def place(column):
    """Where a value stands on the ring: 60 bits of its MD5."""
    hexadecimal = F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, RING_BITS // 4)
    return F.conv(hexadecimal, 16, 10).cast("long")


def ring(spark, shards, replicas, tied=False):
    """One row: the shards of all points in clockwise order, and their places.

    tied: a point is named by its shard and its number within that, so a further shard
    only adds points. Otherwise points are numbered through and dealt to the shards in
    turn, and a further shard gives nearly all of them another owner.
    """
    owner, own = F.floor(F.col("id") / replicas), F.col("id") % replicas
    name = F.concat(F.lit("shard-"), owner, F.lit("-"), own) if tied else F.concat(F.lit("shard-"), F.col("id"))
    points = spark.range(shards * replicas).select(
        place(name).alias("at"), (owner if tied else F.col("id") % shards).cast("int").alias("shard"))
    return points.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("points"))


def arcs(spark, shards, replicas, tied=False):
    """Arc number and place range by cell, for an equality join that a range then narrows."""
    points = ring(spark, shards, replicas, tied).select(F.posexplode("points").alias("arc", "p"),
                                                        F.size("points").alias("n"), "points")
    before = F.when(F.col("arc") == 0, F.lit(-1)).otherwise(F.get("points", F.col("arc") - 1)["at"])
    own = points.select("arc", (before + 1).alias("lo"), F.col("p.at").alias("hi"))
    wrap = points.where(F.col("arc") == F.col("n") - 1).select(
        F.lit(0).alias("arc"), (F.col("p.at") + 1).alias("lo"), F.lit((1 << RING_BITS) - 1).alias("hi"))
    shift = RING_BITS - CELL_BITS
    return own.unionByName(wrap).where("lo <= hi").withColumn(
        "cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))


PIECES = """
aggregate(
  sequence(0, size(counts) - 1),
  named_struct('loads', array_repeat(0L, {shards}),
               'out', cast(array() as array<struct<arc:int,shard:int,lo:bigint,hi:bigint,slot:bigint>>)),
  (acc, a) -> aggregate(
    array_distinct(concat(slice(owners, a + 1, size(owners)), slice(owners, 1, a))),
    named_struct('left', counts[a], 'at', 0L, 'loads', acc.loads, 'out', acc.out),
    (s, shard) -> if(s.left > 0 and s.loads[shard] < room[shard],
      named_struct(
        'left', s.left - least(s.left, room[shard] - s.loads[shard]),
        'at', s.at + least(s.left, room[shard] - s.loads[shard]),
        'loads', transform(s.loads, (v, i) -> if(i = shard, v + least(s.left, room[shard] - v), v)),
        'out', concat(s.out, array(named_struct(
          'arc', a, 'shard', shard, 'lo', s.at,
          'hi', s.at + least(s.left, room[shard] - s.loads[shard]), 'slot', s.loads[shard])))),
      s),
    s -> named_struct('loads', s.loads, 'out', s.out)),
  acc -> acc.out)
"""


def assign(keys, shards=24, replicas=64, slack=0.0, part_rows=4096, tied=False):
    """Put rows into shards.

    keys: any frame with `doc_id`, `size`, `text_crc32`; other columns are left out.
    Returns one row per row: those three, `shard`, `slot` (gapless from 0 in a shard).
    slack: room above the even share, as a part of it; 0 gives counts at most one apart.
    tied: see `ring`; needed wherever the number of shards may change.

    A null doc_id stands where the empty text stands. Repeated rows are told apart by
    a running number and may lie in different shards. Ties on the ring are broken by
    doc_id, size and checksum. An empty table gives an empty table.
    """
    spark = keys.sparkSession
    rows = stored(
        keys.select("doc_id", "size", "text_crc32").groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("at", place(F.col("doc_id"))).withColumn("cell", F.shiftright("at", RING_BITS - CELL_BITS))
        .join(F.broadcast(arcs(spark, shards, replicas, tied)), "cell").where("at between lo and hi")
        .drop("cell", "lo", "hi"), "ring-keys")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    parts_bits = min(40, max(0, (total // part_rows).bit_length()))
    rows = rows.withColumn("part", F.shiftright("at", RING_BITS - parts_bits))

    counts = rows.groupBy("arc", "part").agg(F.sum("copies").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(
        Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    by_place = Window.partitionBy("arc", "part").orderBy("at", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.coalesce(F.sum("copies").over(
        by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(starts, ["arc", "part"])
    ranked = ranked.withColumn("rank", F.explode(F.sequence(
        F.col("start") + F.col("rank"), F.col("start") + F.col("rank") + F.col("copies") - 1)))

    return ranked.join(F.broadcast(pieces(rows, total, shards, replicas, slack, tied)), "arc").where(
        "rank >= lo and rank < hi").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"))


def pieces(rows, total, shards, replicas, slack, tied=False):
    """Which ranks of each arc go to which shard, and the slot of the first of them."""
    spark = rows.sparkSession
    even, more = divmod(total, shards)
    room = [max(int(-(-total * (1 + slack) // shards)), even + (s < more)) if slack else even + (s < more)
            for s in range(shards)]
    per_arc = rows.groupBy("arc").agg(F.sum("copies").alias("n"))
    owner = ring(spark, shards, replicas, tied).select(F.posexplode("points").alias("arc", "p")).select("arc", "p.shard")
    filled = owner.join(per_arc, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    both = filled.groupBy().agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "n"))).alias("arcs")).select(
        F.transform("arcs", lambda x: x["n"]).alias("counts"), F.transform("arcs", lambda x: x["shard"]).alias("owners"))
    return both.withColumn("room", F.array(*[F.lit(r).cast("long") for r in room])).select(
        F.inline(F.expr(PIECES.format(shards=shards))))
