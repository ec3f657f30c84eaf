"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document waits, shuffled, in its source's queue. The virtual finish time of a document is the number of tokens of its
source up to and with it, divided by the source's target; its second and later copies finish one whole queue later each. All
copies are ordered by virtual finish time, over all sources together, and the order is cut where the total budget is used up.

The running sums are made in two levels so that no source goes through one task: sums for each (source, first digits of the
shuffle key), then a running sum inside each of those cells. Rows without an id, or with one id, may all have one shuffle key; where these are very many they make cells of their own,
split by row, between the rows of their cell that come before and those that come after. The cut is found from the sums of BINS ranges of virtual time, then of
FINE ranges inside the one in which it falls, and from the copies of the one range of these that holds it: about one of 34 million.

Nulls, ties and the like: a null source is a source of its own, after all others; a null or empty text has size 0 and is never
taken; documents that agree in id and size stand in any order, which cannot be told apart in the result; of copies with the same
finish time all or none are taken; a long text is split into words as one row of one task; an empty table gives an empty result. Other columns pass through unless they have a name that
the operator adds (size, source_size, target, taken, finish), which is then replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.llm.common import materialize, plain_words

#: Hex digits of the shuffle key that make a cell: 16 ** 3 cells for each source.
CELL_DIGITS = 3
#: Rows with one shuffle key (one id and size) are split by row into PARTS where they are more than a HOT_PARTS-th of all rows, and more than HOT_LEAST.
HOT_PARTS, HOT_LEAST, PARTS = 4096, 10_000, 256
#: Ranges of virtual time up to END; virtual time 1 is where every source has exactly its target.
BINS, END = 4096, 2.0
FINE = 4096
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.size(plain_words(text)).cast("long")


def queue_keys(docs: DataFrame, size: Column, seed: str = "mix") -> DataFrame:
    """Adds size, the source's key (null has its own) and the place in the shuffled queue."""
    docs = docs.withColumn("size", size)
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")))
    return docs.withColumns({"__key": F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")), "__order": order}).withColumn("__cell", F.substring("__order", 1, CELL_DIGITS))


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(__key, source_size) -> the same with target: weighted shares of share * total; what a source cannot take (over cap times its size) goes to the others by weight.

    One row for each source, so its windows are as small as the list of sources. In the order of capacity / weight the sources
    that are full come first; the level is that of the first source that is not.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("__cap") / F.col("__weight"), "__key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.orderBy("__key"))
    weighed = sizes.withColumns({"__weight": F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int")), "__cap": F.col("source_size") * F.lit(float(cap))})
    levels = weighed.withColumns(
        {
            "__total": F.sum("source_size").over(everything) * F.lit(float(share)),
            "__level": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
            "__open": F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)),
            "__rank": F.row_number().over(by_level),
        }
    ).withColumn("__level", (F.col("__total") - F.col("__level")) / F.col("__open"))
    first = F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("__weight"), F.struct("__rank", "__level"))).over(everything)
    return levels.select("__key", "source_size", F.least(F.col("__cap"), F.coalesce(F.col("__weight") * first["__level"], F.col("__cap"))).alias("target"))


def _split_hot(queue: DataFrame) -> DataFrame:
    """queue with __cell as it sorts: (first digits, pieces between hot keys, part of a hot key). queue must be written, since its rows' numbers are used."""
    most = max(queue.count() / HOT_PARTS, HOT_LEAST)
    # No more than HOT_PARTS cells, or keys inside of them, can have more rows than that.
    cells = F.broadcast(queue.groupBy("__key", "__cell").agg(F.count("*").alias("__n")).where(F.col("__n") > most).drop("__n"))
    orders = queue.join(cells, ["__key", "__cell"]).groupBy("__key", "__cell", "__order").agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    hot = F.broadcast(orders.groupBy("__key", "__cell").agg(F.collect_list("__order").alias("__hot")))
    rows = queue.join(hot, ["__key", "__cell"], "left")
    own = F.coalesce(F.array_contains("__hot", F.col("__order")), F.lit(False))
    before = F.coalesce(F.size(F.filter("__hot", lambda h: h < F.col("__order"))), F.lit(0))
    part = F.when(own, F.pmod("__rid", F.lit(PARTS))).otherwise(0).cast("int")
    return rows.withColumn("__cell", F.struct(F.col("__cell").alias("digits"), (2 * before + own.cast("int")).alias("piece"), part.alias("part"))).drop("__hot")


def _finish(rows: DataFrame, cells: DataFrame) -> DataFrame:
    inside = Window.partitionBy("__key", "__cell").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(cells, ["__key", "__cell"]).withColumn("__place", F.col("__before") + F.sum("size").over(inside)).withColumn("finish", F.col("__place") / F.nullif(F.col("target"), F.lit(0.0)))


def _copies(cap: float) -> Column:
    """The finish times of a document's copies."""
    return F.array(*((F.lit(float(k)) * F.col("source_size") + F.col("__place")) / F.nullif(F.col("target"), F.lit(0.0)) for k in range(max(1, math.floor(cap)))))


def _edge(sums: DataFrame, bin_: str, budget: DataFrame, most: str) -> DataFrame:
    """The first range (one row, or none) whose running sum is over the budget, with the room that the ranges before it leave."""
    upto = sums.withColumn("upto", F.sum("used").over(Window.orderBy(bin_)))
    first = upto.join(F.broadcast(budget), F.col("upto") > F.col(most)).agg(F.min(F.struct(bin_, (F.col(most) - F.col("upto") + F.col("used")).alias("room"))).alias("e"))
    return first.where("e is not null").select("e.*")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, size: Column | None = None, keep_columns: bool = True) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, source_size, target, finish and taken (words that the mix takes: a multiple of size)."""
    queued = queue_keys(docs, word_count(F.col("text")) if size is None else size)
    columns = [c for c in (queued.columns if keep_columns else ("doc_id", "size", "__key", "__order", "__cell")) if c != "__rid"]
    queue = _split_hot(materialize(queued.select(*columns).withColumn("__rid", F.monotonically_increasing_id()), "mix-queue"))
    slim = queue.select("doc_id", "size", "__key", "__order", "__cell")
    by_cell = slim.groupBy("__key", "__cell").agg(F.sum("size").alias("__sum"))
    goals = targets(by_cell.groupBy("__key").agg(F.sum("__sum").alias("source_size")), share, cap, weights)
    earlier = Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = by_cell.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum").join(goals, "__key")
    cells = materialize(cells, "mix-cells")

    last = int(BINS * END)
    entries = _finish(slim.where("size > 0"), cells).select("size", F.explode(_copies(cap)).alias("at")).withColumn("bin", F.least(F.floor(F.col("at") * BINS), F.lit(last)).cast("int"))
    budget = cells.select("__key", "source_size").distinct().agg((F.sum("source_size") * F.lit(float(share))).alias("budget"))
    # One row each: bounded, so they may go to every task.
    edge = _edge(entries.groupBy("bin").agg(F.sum("size").alias("used")), "bin", budget, "budget")
    within = entries.join(F.broadcast(edge.select(F.col("bin"), "room")), "bin")
    within = within.select("size", "at", "room", F.least(F.floor((F.col("at") * BINS - F.col("bin")) * FINE), F.lit(FINE - 1)).cast("int").alias("fine"))
    within = materialize(within, "mix-edge")
    inner = _edge(within.groupBy("fine").agg(F.sum("size").alias("used")), "fine", within.select("room").limit(1), "room")
    running = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last_ones = within.drop("room").join(F.broadcast(inner), "fine").withColumn("sum", F.sum("size").over(running)).where("sum <= room").agg(F.max("at").alias("at"))
    # Without a copy that fits in the last range, the cut is at the last one of the ranges before it.
    before = within.join(F.broadcast(inner.select(F.col("fine").alias("edge"))), F.col("fine") < F.col("edge")).agg(F.max("at").alias("at"))
    found = last_ones.unionByName(before).agg(F.max("at").alias("__cut_at"))
    cut = materialize(edge.agg(F.max("bin").alias("__cut_bin")).crossJoin(F.broadcast(found)), "mix-cut")

    rows = _finish(queue, cells).crossJoin(F.broadcast(cut))
    kept = lambda at: F.coalesce((F.col("__cut_bin").isNull() | (F.least(F.floor(at * BINS), F.lit(last)) < F.col("__cut_bin")) | (at <= F.coalesce(F.col("__cut_at"), F.lit(-1.0)))), F.lit(False))
    rows = rows.withColumn("taken", F.col("size") * F.size(F.filter(_copies(cap), kept)))
    return rows.drop("__key", "__order", "__cell", "__rid", "__before", "__place", "__cut_bin", "__cut_at")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all columns of docs as they are."""
    mixed = mix(docs.select("doc_id", "source", "text", F.struct("*").alias("__row")), **how)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
