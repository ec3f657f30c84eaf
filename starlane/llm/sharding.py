"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns VNODES points of the ring; a document's id gives its place on it, and the next point clockwise names its home
shard. No shard takes more than (1 + SLACK) times the mean of bytes: what finds its shard full goes on clockwise to the first
shard with room (or, if none has room for so large a document, to the emptiest).

The ring is cut into 2 ** CELL_BITS cells, and a cell goes to one shard as a whole, so the walk needs only the cells' bytes: a
table of fixed length, however many documents there are. Cells that hold more than HOT of SPLITS equal parts of all rows or bytes (many rows with one
id, or null ids) are split by row into parts of about that size, each of which walks on its own. Heavier cells walk first, then by place on
the ring. Slots are the running row number in a cell, after the rows of the cells that come before it in its shard.

Law `bytes`: sizes (UTF-8 bytes + 1) are near equal. Nulls, ties and the like: a null text has size 1 and no CRC; a null id is
an id like others; repeated rows each get a slot of their own; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlane.llm.common import materialize

SHARDS, VNODES, SLACK = 16, 1024, 0.0005
CELL_BITS = 16
#: A cell with more than HOT of SPLITS equal parts of all rows or bytes is split by row into parts of about that size.
SPLITS, HOT = 1 << 14, 4


def _place(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard), by place."""
    return sorted((_place("shard", s, v), s) for s in range(shards) for v in range(vnodes))


def walk(cells: list[tuple[int, int, int]], shards: int, vnodes: int = VNODES, slack: float = SLACK) -> dict[tuple[int, int], tuple[int, int]]:
    """(cell, split, bytes) -> {(cell, split): (shard, home shard)}. Works on the cells' table only, never on rows."""
    points = ring(shards, vnodes)
    places = [p for p, _ in points]
    cap = (1 + slack) * sum(b for *_, b in cells) / shards
    load, out = [0] * shards, {}
    at = {(c, k): (c << 64 - CELL_BITS) if k < 0 else _place("part", c, k) for c, k, _ in cells}
    for c, k, size in sorted(cells, key=lambda x: (-x[2].bit_length(), at[x[:2]], x[:2])):
        first = bisect.bisect_left(places, at[c, k]) % len(points)
        seen: set[int] = set()
        for step in range(len(points)):
            shard = points[(first + step) % len(points)][1]
            if load[shard] + size <= cap:
                break
            seen.add(shard)
            if len(seen) == shards:
                shard = min(range(shards), key=lambda s: (load[s], s))
                break
        load[shard] += size
        out[c, k] = shard, points[first][1]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """A row for each of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), home_shard."""
    spark = docs.sparkSession
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - CELL_BITS).cast("int").alias("cell"),
        F.monotonically_increasing_id().alias("rid"),
    )
    keyed = materialize(keyed, "shard-keys")
    # At most 2 ** CELL_BITS rows, and about 2 * SPLITS more for the parts of hot cells.
    whole = {r.cell: r for r in keyed.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()}
    part_rows, part_bytes = (max(1.0, sum(n) / SPLITS) for n in ([r.rows for r in whole.values()], [r.bytes for r in whole.values()]))
    parts = {c: min(r.rows, math.ceil(max(r.rows / part_rows, r.bytes / part_bytes))) for c, r in whole.items()}
    hot = {c: n for c, n in parts.items() if n > HOT}
    counts = {(c, -1): (r.rows, r.bytes) for c, r in whole.items() if c not in hot}
    split = F.broadcast(spark.createDataFrame(sorted(hot.items()), "cell int, parts int"))
    keyed = keyed.join(split, "cell", "left").withColumn("split", F.coalesce(F.pmod("rid", "parts").cast("int"), F.lit(-1))).drop("rid", "parts")
    if hot:
        counts |= {(r.cell, r.split): (r.rows, r.bytes) for r in keyed.where("split >= 0").groupBy("cell", "split").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()}
    to = walk([(*k, b) for k, (_, b) in counts.items()], shards, vnodes, slack)
    filled, plan = [0] * shards, []
    for key in sorted(to):
        s, home = to[key]
        plan.append((*key, s, filled[s], home))
        filled[s] += counts[key][0]
    cells = spark.createDataFrame(plan, "cell int, split int, shard int, before long, home_shard int")
    inside = Window.partitionBy("cell", "split").orderBy("doc_id", "size", "text_crc32")
    rows = keyed.withColumn("n", F.row_number().over(inside)).join(F.broadcast(cells), ["cell", "split"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")
