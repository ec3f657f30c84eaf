"""Hard-negative mining by a secondary sort.

A row's label is its class; anchors are rows of a stated kind (by default those whose id is divisible by 100). A pair's score is the integer inner
product of two vectors whose components are floor(256 x). An anchor's positives are the first POSITIVES other rows of its label,
and the negatives of a positive are the first NEGATIVES rows of other labels whose score is at least LOW percent of the positive's
and no more than it. First means by score, highest first, then by smaller id.

Rows are packed into blocks, and blocks of anchors meet blocks of rows in a grid: each cell is one task's product of two matrices, so
neither all anchors nor all rows are ever in one place. Pairs that matter become keys of bytes (anchor, score from the highest, positives
before negatives, id), which order as they should when compared as bytes; repartitionAndSortWithinPartitions deals them by anchor
and sorts them in the shuffle. One iterator then reads each anchor's pairs in a stream: a positive opens a window, a negative is
given to the open windows that still have room and whose lower end it reaches, and windows that are full or passed are closed. Only the open windows are held.

The grid is passed twice. First each cell hands on its best POSITIVES rows of each anchor's label, of which the sort keeps as many; then,
these being known, each cell hands on, for each positive, the best NEGATIVES rows of its window. A row that its own cell does not hand on is behind as many of
the same cell, so no result is lost, and a hot label or a large group of copies sends no more than that from a cell.

Nulls, ties and the like: rows with a null id, a null label, a null vector, or a null or not finite component take no part; components that a shorter
vector lacks are 0; rows with the anchor's id are not "other" rows of it, so a row that stands twice is no positive of its copy, but
both are met as rows of other anchors; an anchor that stands twice gives its results twice; scores that do
not fit in 64 bits count as the largest or smallest that do; empty tables give an empty result. Only the id, the label and the vector are read,
whatever other columns are called.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlane.llm.common import materialize

POSITIVES, NEGATIVES, LOW = 5, 5, 80
#: Rows and anchors in a block at most. A cell's scores are made STRIP anchors at a time.
ROWS, ANCHORS, STRIP = 16_384, 4_096, 128
#: A key: anchor's id, its number (so that copies of an anchor stay apart), score from the highest, 0 for a positive and 1 for a negative, id. Signs are turned so that bytes compare as numbers do.
KEY = struct.Struct(">QQQBQ")
TURN, MOST = 1 << 63, (1 << 63) - 1
#: Stands where an anchor has fewer positives. The window of a score below 0 is empty anyway.
NONE = -MOST
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
BLOCK = pa.schema([("block", pa.int64()), ("number", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("kind", pa.string()), ("matrix", pa.binary()), ("bounds", pa.binary())])


def pack(anchor: int, number: int, score: int, negative: int, id_: int) -> bytes:
    return KEY.pack(anchor + TURN, number, MOST - score, negative, id_ + TURN)


def unpack(key: bytes) -> tuple[int, int, int, int, int]:
    anchor, number, score, negative, id_ = KEY.unpack(key)
    return anchor - TURN, number, MOST - score, negative, id_ - TURN


def usable(rows: DataFrame, id_: str, label: Column, vector: str, is_anchor: Column) -> DataFrame:
    """id, label, is_anchor and vector (doubles) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    columns = F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")
    return rows.select(*columns, F.when(finite, F.col(vector).cast("array<double>")).alias("vector")).where("id is not null and label is not null and vector is not null")


def _packed(part: list[tuple]) -> pa.RecordBatch:
    """A block of rows (id, number, label, vector, scores of positives), in order of id."""
    part.sort(key=lambda r: r[:2])
    ids, numbers, labels = (np.array([r[i] for r in part], np.int64) for i in range(3))
    matrix = np.zeros((len(part), max(len(r[3]) for r in part)))
    for i, r in enumerate(part):
        matrix[i, : len(r[3])] = np.floor(256 * r[3])
    kind = "i2" if np.abs(matrix).max(initial=0) < 1 << 15 else "f8"
    bounds = np.array([[*r[4], *[NONE] * (POSITIVES - len(r[4]))] for r in part], np.int64)
    values = int(numbers[0]), numbers.tobytes(), ids.tobytes(), labels.tobytes(), matrix.shape[1], kind, matrix.astype(kind).tobytes(), bounds.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, BLOCK.types, strict=True)], schema=BLOCK)


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """The rows of a partition, `most` at a time; with a column bounds, each anchor's scores of positives too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            offsets = batch.column("vector").offsets.to_numpy()
            flat = batch.column("vector").flatten().to_numpy()
            ids, numbers, labels = (batch.column(c).to_pylist() for c in ("id", "number", "label"))
            bounds = batch.column("bounds").to_pylist() if "bounds" in batch.schema.names else [()] * batch.num_rows
            for i in range(batch.num_rows):
                held.append((ids[i], numbers[i], labels[i], flat[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]], bounds[i]))
                if len(held) == most:
                    yield _packed(held)
                    held = []
        if held:
            yield _packed(held)

    return rows.mapInArrow(run, "block long, number binary, ids binary, labels binary, width int, kind string, matrix binary, bounds binary")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices of whole doubles."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def _first(x: np.ndarray, y: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries of a matrix, each row's first k by score, then by column (columns are in order of id)."""
    order = np.lexsort((y, -scores, x))
    x, y = x[order], y[order]
    kept = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[kept], y[kept]


def best_positives(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each row's first k columns that fit."""
    if scores.shape[1] > k:
        order = np.where(fits, scores, -MOST - 1)
        fits = fits & (order >= np.partition(order, -k, axis=1)[:, -k, None])
    x, y = np.nonzero(fits)
    return _first(x, y, scores[x, y], k)


def best_negatives(scores: np.ndarray, fits: np.ndarray, positives: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each row's first k columns that fit in the window of any of its positives (a row of their scores; NONE where there are fewer)."""
    least = np.array([MOST if p == NONE else -(-LOW * p // 100) for p in positives.ravel().tolist()], np.int64).reshape(positives.shape)
    x, y = np.nonzero(fits & (scores <= positives.max(axis=1)[:, None]) & (scores >= least.min(axis=1)[:, None]))
    own, found = scores[x, y], [np.zeros(0, np.int64)]
    for j in range(positives.shape[1]):
        inside = (own <= positives[x, j]) & (own >= least[x, j])
        r, c = _first(x[inside], y[inside], own[inside], k)
        found.append(r * scores.shape[1] + c)
    return np.divmod(np.unique(np.concatenate(found)), scores.shape[1])


def _cells(anchors: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Every block of anchors with every block of rows. Both are dealt into as many buckets as there are blocks of their kind, and copied to all buckets of the other."""
    high, wide = max(1, anchors.count()), max(1, rows.count())
    bucket = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(*(F.col(c).alias(f"a_{c}") for c in ("number", "ids", "labels", "width", "kind", "matrix", "bounds")), bucket(high).alias("i"), every(wide).alias("j"))
    right = rows.select("ids", "labels", "width", "kind", "matrix", every(high).alias("i"), bucket(wide).alias("j"))
    # A cell's work is far larger than its bytes, so the number of tasks is given and not left to the sizes.
    tasks = min(high * wide, 4 * parts)
    return left.repartition(tasks, "i", "j").join(right.repartition(tasks, "i", "j"), ["i", "j"])


def _matrix(kind: str, data: bytes, width: int, most: int) -> np.ndarray:
    out = np.frombuffer(data, kind).reshape(-1, width).astype(np.float64)
    return np.pad(out, ((0, 0), (0, most - width)))


def _pairs(cells: DataFrame, negatives: bool) -> DataFrame:
    """The keys of the pairs that a cell hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                width = max(c["a_width"], c["width"])
                a, b = _matrix(c["a_kind"], c["a_matrix"], c["a_width"], width), _matrix(c["kind"], c["matrix"], c["width"], width)
                a_ids, a_labels, numbers = (np.frombuffer(c[n], np.int64) for n in ("a_ids", "a_labels", "a_number"))
                ids, labels = np.frombuffer(c["ids"], np.int64), np.frombuffer(c["labels"], np.int64)
                for s in range(0, len(a), STRIP):
                    strip = slice(s, s + STRIP)
                    scores, same = _product(a[strip], b), a_labels[strip, None] == labels[None, :]
                    if negatives:
                        x, y = best_negatives(scores, ~same, np.frombuffer(c["a_bounds"], np.int64).reshape(-1, POSITIVES)[strip], NEGATIVES)
                    else:
                        x, y = best_positives(scores, same & (a_ids[strip, None] != ids[None, :]), POSITIVES)
                    keys = [pack(*k) for k in zip(a_ids[strip][x].tolist(), numbers[strip][x].tolist(), scores[x, y].tolist(), [int(negatives)] * len(x), ids[y].tolist(), strict=True)]
                    if keys:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    return cells.mapInArrow(run, "key binary")


def secondary_sort(keys: RDD, parts: int) -> RDD:
    """(key, None) dealt by anchor and sorted inside each partition."""
    return keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))


def _keys(pairs: DataFrame) -> RDD:
    return pairs.rdd.map(lambda r: (bytes(r[0]), None))


def first_positives(keys: Iterator[tuple[bytes, None]], most: int = POSITIVES) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Each anchor's first positives: id, number, ids, scores."""
    for (anchor, number), pairs in groupby((unpack(k) for k, _ in keys), lambda p: p[:2]):
        kept = [(p[4], p[2]) for _, p in zip(range(most), pairs, strict=False)]
        yield anchor, number, [i for i, _ in kept], [s for _, s in kept]


def windows(keys: Iterator[tuple[bytes, None]], most: int = POSITIVES, each: int = NEGATIVES, low: int = LOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Reads sorted pairs in a stream: positives open windows, negatives go to those that are open. FOUND's rows."""
    now, opened, open_ = None, 0, []
    for key, _ in keys:
        anchor, number, score, negative, id_ = unpack(key)
        if (anchor, number) != now:
            now, opened, open_ = (anchor, number), 0, []
        if not negative:
            if opened < most:
                open_.append([id_, score, 0])
                opened += 1
            continue
        # What is too far below a window now is so for good.
        open_ = [w for w in open_ if w[2] < each and low * w[1] <= 100 * score]
        for w in open_:
            if score <= w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], id_, w[1], score


def mine(rows: DataFrame, id_: str = "vec_id", label: Column | None = None, vector: str = "embedding", anchor: Column | None = None) -> DataFrame:
    """FOUND: the hard negatives of each positive of each anchor. label and anchor are columns over rows; by default the column named label, and ids divisible by 100."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vectors = usable(rows, id_, F.col("label") if label is None else label, vector, F.col(id_) % 100 == 0 if anchor is None else anchor)
    table = materialize(vectors.withColumn("number", F.monotonically_increasing_id()), "vectors")
    blocks = materialize(_blocks(table, ROWS), "vector-blocks")
    anchors = table.where("is_anchor")
    # As few blocks of anchors as there can be: all rows meet each of them.
    few = max(1, -(-anchors.count() // ANCHORS))
    once = materialize(_blocks(anchors.repartition(few), ANCHORS), "anchor-blocks")
    found = secondary_sort(_keys(_pairs(_cells(once, blocks, parts), negatives=False)), parts).mapPartitions(first_positives)
    positives = materialize(spark.createDataFrame(found, "anchor long, number long, ids array<long>, scores array<long>", verifySchema=False), "positives")
    bounded = anchors.join(positives.select("number", F.col("scores").alias("bounds")), "number")
    again = materialize(_blocks(bounded.repartition(few), ANCHORS), "anchor-blocks")
    negatives = materialize(_pairs(_cells(again, blocks, parts), negatives=True), "negative-keys")
    opening = positives.rdd.flatMap(lambda r: [(pack(r[0], r[1], s, 0, i), None) for i, s in zip(r[2], r[3], strict=True)])
    return spark.createDataFrame(secondary_sort(_keys(negatives).union(opening), parts).mapPartitions(windows), FOUND, verifySchema=False)
