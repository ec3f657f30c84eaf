r"""Ranked lexical search: the best documents for each item, by an integer form of BM25, over posting lists in geometric blocks.

Terms are runs of digits, letters and all beyond ASCII, with A-Z lower-cased. With N documents that have a term, L terms in all of
them, n in a document, df documents that hold a term and tf times in one: a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))),
a document has m = 10 + 90 n N div L, and its score is the sum of w * (10^9 tf div (1000 tf + 8 m)) over the item's terms.

`build` makes an index of a vocabulary. One pass over the texts keeps, for every document, n and how often it holds each term of the
vocabulary; N, L and df are summed from that table. A second pass cuts it into segments of at most SEGMENT_DOCS documents or SEGMENT_POSTINGS postings.
In a segment each term has its posting list, in order of rarity. The list is clustered by document similarity: its
documents are compared, by sketches of their weighted terms, with representatives taken from the list itself, join the most similar one,
and clusters are cut into blocks of BLOCK documents at most. With each block its summary is stored: the largest impact of each coordinate in
any of its documents. Coordinates are the terms as common as the list's own or more so, since a document of the list that holds a rarer term of an item
stands in that term's list too, where its bound covers them all. The index is a table, a row for each segment's documents and one for each of its lists.

`Index.search` takes items whose terms are in the vocabulary. In each segment an item's lists are gone through, the rarest term first. A summary times the item's weights is an exact
upper bound of what the block's documents can score beyond lists already done. A block is skipped only if its bound is below the item's k-th best score so far, and a list with all after it only if the sum of their
largest impacts is; documents of other blocks are scored in full. So the result is that of scoring every document.

Every segment hands on k documents of each item; those are ranked. `search` indexes the items' own terms, in rounds of ITEMS rows or ITEM_CHARS
characters; each round passes over all documents, so neither terms nor scores of all items are ever in one place.

Nulls, ties and the like: a null or empty text has no terms and is not among the N documents; an item without terms that some
document holds has no rows; repeated items are ranked each for itself, and null ids of items are kept; documents of equal score stand by id,
those without an id last, and repeated rows are ranked like any others; a long text is counted in pieces of PIECE bytes;
empty tables give an empty result. Only doc_id, item_id and the texts are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlane.llm.common import materialize

TOP = 10
ITEMS, ITEM_CHARS = 2000, 4_000_000
SEGMENT_DOCS, SEGMENT_POSTINGS = 16_384, 2_000_000
#: Documents in a block at most, and dimensions of the sketches that are compared.
BLOCK, SKETCH = 128, 32
PIECE = 1 << 20
FORWARD = "doc_id long, n long, terms array<int>, times array<int>"
FOUND = "item long, doc_id long, score long"
#: A segment's documents (term -1): ids, sizes, terms, impacts; or one of its lists: what List has. Numbers as bytes, ids of 64 bits and all else of 32.
INDEX = "segment long, term int, a binary, b binary, c binary, d binary, e binary"
#: Coordinates of lists in one Arrow batch.
STORED = 1 << 20
#: Bytes as terms have them: A-Z in lower case, and a space for all of ASCII that is in no term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a piece at a time."""
    text = text.translate(FOLD)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """One text at a time, in UTF-8; null as empty."""
    column = batch.column(name).cast(pa.large_binary() if pa.types.is_large_string(batch.column(name).type) else pa.binary())
    for i in range(batch.num_rows):
        yield column[i].as_py() or b""


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the terms of the vocabulary that it holds with how often; documents without any term are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in _bytes(batch, "text"):
                n, known = 0, []
                for piece in words(text):
                    n += len(piece)
                    known += [t for t in map(vocabulary.get, piece) if t is not None]
                found, often = np.unique(np.array(known, np.int32), return_counts=True)
                sizes.append(n)
                terms.append(found)
                times.append(often.astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"]).filter(pa.array(np.array(sizes) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, FORWARD)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Segment:
    """Documents of one segment with their impacts by row, and their posting lists.

    Terms are numbered by rarity, and stand in that order in each row, so what a row has from a term on is one range.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray):
        self.ids, self.sizes, self.terms, self.impacts, self.weights = ids, sizes, terms, impacts, weights
        self.starts = np.cumsum(sizes) - sizes
        self.largest = np.zeros(len(weights), np.int64)
        np.maximum.at(self.largest, terms, impacts)

    def sketches(self) -> np.ndarray:
        """A few random projections of each document's weighted terms, of length 1."""
        signs, ends = np.random.default_rng(12).choice(np.array([-1, 1], np.float32), (len(self.weights), SKETCH)), self.starts + self.sizes
        out = np.empty((len(self.sizes), SKETCH), np.float32)
        for a in range(0, len(out), 1024):
            s, e = self.starts[a], ends[min(a + 1024, len(out)) - 1]
            t = self.terms[s:e]
            out[a : a + 1024] = np.add.reduceat(signs[t] * (self.impacts[s:e] * self.weights[t]).astype(np.float32)[:, None], self.starts[a : a + 1024] - s)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def lists(self) -> Iterator[tuple[int, List]]:
        """Every term's list in blocks, with summaries."""
        order = np.argsort(self.terms, kind="stable")
        edges = np.searchsorted(self.terms[order], np.arange(len(self.weights) + 1))
        row, ends, sketches = np.repeat(np.arange(len(self.sizes)), self.sizes), self.starts + self.sizes, self.sketches()
        for term in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[term] : edges[term + 1]]
            rows = row[at]
            if len(rows) > BLOCK:
                cluster = np.argmax(sketches[rows] @ sketches[rows[::BLOCK]].T, axis=1)
                by = np.argsort(cluster, kind="stable")
                rows, at, cluster = rows[by], at[by], cluster[by]
                begins = np.flatnonzero((np.arange(len(rows)) - np.searchsorted(cluster, cluster)) % BLOCK == 0)
            else:
                begins = np.zeros(1, np.int64)
            sizes = ends[rows] - at
            entries = _joined(at, sizes)
            block = np.repeat(np.searchsorted(begins, np.arange(len(rows)), "right") - 1, sizes)
            width = len(self.weights) - term
            summary = np.zeros(len(begins) * width, np.int32)
            np.maximum.at(summary, block * width + self.terms[entries] - term, self.impacts[entries].astype(np.int32))
            found = np.flatnonzero(summary)
            yield term, List(rows, begins, np.searchsorted(found, np.arange(len(begins)) * width), found % width + term, summary[found])

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Full scores of documents; asked: the item's weight of every term, 0 for those that it has not."""
        sizes = self.sizes[rows]
        entries = _joined(self.starts[rows], sizes)
        return np.add.reduceat(asked[self.terms[entries]] * self.impacts[entries], np.cumsum(sizes) - sizes)


class List(NamedTuple):
    """A posting list: documents, block by block; where blocks begin; where their summaries begin, and these as coordinates and largest impacts."""

    rows: np.ndarray
    begins: np.ndarray
    summaries: np.ndarray
    coordinates: np.ndarray
    largest: np.ndarray

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """What each block's documents can score at most, of the terms asked for. Every block has its own term for a coordinate."""
        return np.add.reduceat(asked[self.coordinates] * self.largest, self.summaries)


class Best:
    """The k best documents of an item so far: score first, then the smaller id (the largest number stands for none)."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a document has to score at least to matter."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least()
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_segment(segment: Segment, lists: dict[int, List], terms: np.ndarray, best: Best) -> int:
    """Adds the segment's documents that may be among the item's best; terms: the item's, rarest first. How many were scored."""
    asked = np.zeros(len(segment.weights), np.int64)
    asked[terms] = segment.weights[terms]
    rest = np.cumsum((asked[terms] * segment.largest[terms])[::-1])[::-1]
    seen, scored = np.zeros(len(segment.ids), bool), 0
    for i, term in enumerate(terms.tolist()):
        if rest[i] < best.least():
            break  # no document without a rarer term can matter
        if term not in lists:
            continue
        own = lists[term]
        bounds, ends = own.bounds(asked), np.append(own.begins[1:], len(own.rows))
        order, done, step = np.argsort(-bounds, kind="stable"), 0, 1
        while done < len(order) and bounds[order[done]] >= best.least():
            take = order[done : done + step]
            take = take[bounds[take] >= best.least()]
            docs = own.rows[_joined(own.begins[take], ends[take] - own.begins[take])]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                scored += len(docs)
                best.add(segment.scores(docs, asked), segment.ids[docs])
            done, step = done + step, step * 2
    return scored


def _segments(batches: Iterator[pa.RecordBatch], rank: np.ndarray, weights: np.ndarray, documents: int, total: int) -> Iterator[Segment]:
    """The forward table's rows in segments, with impacts; documents without a term of the vocabulary are passed over."""

    def made(parts: list[tuple]) -> Segment:
        ids, n, sizes, terms, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = np.repeat(np.arange(len(sizes)), sizes)
        m = 10 + (90 * n * documents) // total
        times = times.astype(np.int64)
        impacts = (1_000_000_000 * times) // (1000 * times + 8 * m[row])
        terms = rank[terms]
        order = np.lexsort((terms, row))
        return Segment(ids, sizes, terms[order], impacts[order], weights)

    parts: list[tuple] = []
    docs = postings = 0
    for batch in batches:
        lists = batch.column("terms")
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        terms, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
        ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        n = batch.column("n").to_numpy()
        upto = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            # As many rows as the open segment has room for, one at least.
            before = upto[a - 1] if a else 0
            b = min(a + SEGMENT_DOCS - docs, int(np.searchsorted(upto, before + SEGMENT_POSTINGS - postings, "right")))
            b = max(b, a if parts else a + 1)
            if b > a:
                has = sizes[a:b] > 0
                parts.append((ids[a:b][has], n[a:b][has], sizes[a:b][has], terms[before : upto[b - 1]], times[before : upto[b - 1]]))
                docs, postings = docs + int(has.sum()), postings + int(upto[b - 1] - before)
            if b < len(sizes):
                if postings:
                    yield made(parts)
                parts, docs, postings = [], 0, 0
            a = b
    if postings:
        yield made(parts)


def _stored(number: int, segment: Segment) -> Iterator[pa.RecordBatch]:
    """INDEX's rows of a segment: its documents (term -1), and its lists, some to a batch."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        numbers = [pa.array([number] * len(rows), pa.int64()), pa.array(columns[0], pa.int32())]
        return pa.RecordBatch.from_arrays([*numbers, *(pa.array([x.tobytes() for x in c], pa.binary()) for c in columns[1:])], ["segment", "term", "a", "b", "c", "d", "e"])

    i32 = lambda x: x.astype(np.int32)
    yield batch([(-1, segment.ids, i32(segment.sizes), i32(segment.terms), i32(segment.impacts), np.zeros(0, np.int32))])
    rows, held = [], 0
    for term, own in segment.lists():
        rows.append((term, *map(i32, own)))
        held += len(own.coordinates)
        if held > STORED:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


class _Lists(dict):
    """A segment's lists, each taken from the group's buffers (without a copy) when it is first asked for: most are never reached."""

    def __init__(self, group: pa.Table):
        super().__init__()
        self.group, self.at = group, {t: i for i, t in enumerate(group.column("term").to_pylist()) if t >= 0}

    def ints(self, i: int, column: str, kind: type = np.int32) -> np.ndarray:
        return np.frombuffer(self.group.column(column)[i].as_buffer(), kind)

    def __contains__(self, term: object) -> bool:
        return term in self.at

    def __iter__(self) -> Iterator[int]:
        return iter(self.at)

    def __missing__(self, term: int) -> List:
        i = self.at[term]
        self[term] = List(*(self.ints(i, c) for c in "abcde"))
        return self[term]


def _read(group: pa.Table, weights: np.ndarray) -> tuple[Segment, _Lists]:
    lists = _Lists(group)
    i = group.column("term").to_pylist().index(-1)
    return Segment(lists.ints(i, "a", np.int64), *(lists.ints(i, c).astype(np.int64) for c in "bcd"), weights), lists


@dataclass(frozen=True)
class Index:
    """A table of INDEX, the vocabulary with each term's number (by rarity), and the terms' weights by number."""

    table: DataFrame
    vocabulary: dict[bytes, int]
    weights: np.ndarray

    def search(self, items: list[tuple[int, bytes]], k: int = TOP) -> DataFrame:
        """FOUND: k documents of each item (number, text in UTF-8) and segment at most. The items come as a list, for they go to every task; see search() for tables."""
        asked = []
        for item, text in items:
            own = {t for piece in words(text) for t in piece}
            if not own <= self.vocabulary.keys():
                raise ValueError(f"item {item} has terms that the index was not built for")
            asked.append((item, np.array(sorted(self.vocabulary[t] for t in own), np.int64)))
        weights = self.weights

        def run(group: pa.Table) -> pa.Table:
            segment, lists = _read(group, weights)
            none, out = np.iinfo(np.int64).max, []
            for item, terms in asked:
                best = Best(k)
                search_segment(segment, lists, terms, best)
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), item)), pa.array(best.ids, pa.int64(), mask=best.ids == none), pa.array(best.scores, pa.int64())], ["item", "doc_id", "score"]))
            return pa.Table.from_batches(out, pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

        return self.table.groupBy("segment").applyInArrow(run, FOUND)


def build(docs: DataFrame, terms: Iterable[bytes]) -> Index:
    """An index of all docs (doc_id, text) for a vocabulary, which goes to every task."""
    vocabulary = {t: i for i, t in enumerate(sorted(set(terms)))}
    table = materialize(forward(docs, vocabulary), "forward")
    documents, total = table.agg(F.count("*"), F.sum("n")).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for term, n in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as the vocabulary has terms
        holding[term] = n
    order = np.argsort(holding, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    weights = np.array([weight(documents, int(holding[t])) for t in order], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of segments are those of their partition and their place in it, so a task that is run again gives the same.
        first = TaskContext.get().partitionId() << 32
        for nth, segment in enumerate(_segments(batches, rank, weights, documents, total)):
            yield from _stored(first + nth, segment)

    stored = materialize(table.mapInArrow(cut, INDEX), "blocks", compression="zstd")
    return Index(stored, {t: int(rank[i]) for t, i in vocabulary.items()}, weights)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    items = materialize(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    rounds = max(1, math.ceil(count / ITEMS), math.ceil(chars / ITEM_CHARS))
    found = spark.createDataFrame([], FOUND)
    for r in range(rounds if count else 0):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r).select("item", F.encode("text", "UTF-8").alias("text")).collect()
        if own:
            asked = [(x.item, bytes(x.text)) for x in own]
            index = build(docs, {t for _, text in asked for piece in words(text) for t in piece})
            found = found.unionByName(index.search(asked, k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
