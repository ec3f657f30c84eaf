r"""N-gram Jaccard join by vertical partitioning.

A document's set holds the hashes of its distinct shingles (runs of `words` words; a shorter text is one shingle). The global order
of shingles is the order of their hashes. It is cut into fragments, in two of three steps:

1. Filter. Documents are classed by set size. In each class the order is cut into F fragments, one more than the largest number of
   shingles by which two linked sets of that class can differ, and a sixth more. A linked set differs in no more fragments than it
   differs in shingles, so it has all but that many of a document's fragments that are not empty, and a document stays only if so
   many of them (by a hash of each, with the class) stand in other documents too. Empty fragments have no hash; a document with too
   few others for this always stays. Fragments that very many documents have are named by a sample of the texts, which proves that
   they are shared; they are counted where they arise, so that no task gets all documents that have one.
2. Candidates. Over the documents that are left shingles are ordered by how rare they are, and only documents that share one of the
   rarest (1 - t) n + 1 shingles, under bounds on sizes, places and unshared shingles, become candidates. First each document is
   compared with the one that it shares most of them with. What then lies in different components is compared with the first
   document of each shared shingle, its pivot, and only those pairs whose differences from their pivot agree enough are left.
3. Overlaps. Each candidate pair's overlap is counted in each of FRAGMENTS fragments separately and summed.

Equal sets are one class throughout: copies meet only in a count, and are never paired. Classes are told apart by a fingerprint of
64 bits, shingles by 64-bit hashes: of n different texts about n^2 / 2^65 pairs are taken for copies by chance (three of 10^10 texts).

The result is exact but for collisions of those hashes. Nulls, ties and the like: null texts and texts without words have an empty set and
are linked with nothing; a null id is no one's smallest id, and rows with null ids still get their component; repeated rows each get
theirs; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlane.llm.common import materialize

WORDS, PERCENT = 3, 90
FRAGMENTS = 8
#: Sizes in a class differ by this factor at most; it must be more than 100 / percent.
CLASS_RATIO = 1.4
#: Classes are told apart by this many values in the low bits of a signature (neighbours never fall together).
CLASSES = 64
BLOCK = 1 << 20
#: Signatures that HOT_LEAST texts or more of a HOT_SAMPLE-th of all have, HOT_MOST at most, are counted in place.
HOT_SAMPLE, HOT_LEAST, HOT_MOST = 64, 32, 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_SPACE[a], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    size = 1 << max(10, int(a.size).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[a] * _powers(_BASE, size)[: a.size], dtype=np.uint64)))
    return _mix((sums[end] - sums[start]) * _powers(_BACK, size)[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word, A-Z lower-cased; long texts go block by block, cut at white space."""
    data, out, at = text.lower(), [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The hashes of the distinct shingles, in order."""
    h = word_hashes(text)
    if not h.size:
        return h
    k = min(words, h.size)
    out = np.full(h.size - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out + h[j : h.size - k + 1 + j])
    return np.unique(out)


def fingerprint(s: np.ndarray) -> int:
    m = _mix(s ^ np.uint64(0xA0761D6478BD642F))
    both = (int(m.sum(dtype=np.uint64)) + 3 * int(np.bitwise_xor.reduce(s))) % (1 << 64)
    return int(_mix(np.array([both], np.uint64)).view(np.int64)[0])


@cache
def size_class(n: int) -> tuple[int, int, int]:
    """(number, smallest size, largest size) of the class of sets of size n."""
    number, low = 0, 1
    while True:
        high = max(low, int(low * CLASS_RATIO))
        if n <= high:
            return number, low, high
        number, low = number + 1, high + 1


def most_different(n: int, largest: int, percent: int) -> int:
    """By how many shingles a set of size n can differ from a linked one of size up to largest."""
    return (n + min(largest, n * 100 // percent)) * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray, int]]:
    """(class, hashes of the set's fragments, how many of them it shares with any set it is linked to), in its own size class and in the next if a linked set may lie there.

    The class stands in the low bits of each hash. There are more fragments than a linked set can differ in, so some must agree; that
    many, less the set's own empty ones, is what a document must share with others to stay. Where that is less than one (0), the
    document stays whatever it shares. Empty fragments have no hash: what a linked set must share with it, it shares in others.
    """
    number, _, high = size_class(s.size)
    classes = [(number, high)]
    if 100 * s.size >= percent * (high + 1):
        number, _, high = size_class(high + 1)
        classes.append((number, high))
    out = []
    for number, high in classes:
        different = most_different(high, high, percent)
        count = different + 1 + (1 + different // 6 if different else 0)
        f = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        f, sums = f[begin], np.add.reduceat(_mix(s), begin)
        need = max(0, begin.size - most_different(s.size, high, percent))
        hashes = _mix(sums ^ _mix(f + np.uint64((number + 1) << 32)))
        out.append((number % CLASSES, hashes & np.uint64(2**64 - CLASSES) | np.uint64(number % CLASSES), need))
    return out


def _texts(batches: Iterator[pa.RecordBatch], words: int, once: bool) -> Iterator[tuple[int | None, bytes, np.ndarray, int]]:
    """(doc_id, text, set, fingerprint) of each text with words; with once, the first of each fingerprint in this task only."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
        for doc_id, value in zip(ids, batch.column("text"), strict=True):
            text = value.as_buffer().to_pybytes() if value.is_valid else b""
            s = shingles(text, words)
            name = fingerprint(s) if s.size else 0
            if once and (not s.size or name in seen):
                continue
            seen.add(name) if once else None
            yield doc_id, text, s, name


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), cls (its fingerprint; null for an empty set), a row for each of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((d, s.size, name if s.size else None) for d, _, s, name in _texts(batches, words, False)), schema, 10_000)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, cls long")


def _emitted(docs: DataFrame, words: int, percent: int, hot: np.ndarray) -> DataFrame:
    """sig, cls, known: a row for each signature (known is null); those of a class that are in hot (sorted) are counted in one row of their own."""
    schema = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("known", pa.int32())])

    def found(s: np.ndarray, name: int) -> Iterator[tuple[np.ndarray, list[int | None]]]:
        for c, h, _ in signatures(s, percent):
            h = h.view(np.int64)
            known = hot[np.searchsorted(hot, h).clip(max=hot.size - 1)] == h if hot.size else np.zeros(h.size, bool)
            rest, n = h[~known], int(known.sum())
            yield rest, [None] * rest.size
            if n:
                yield np.array([name & -CLASSES | c], np.int64), [n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, names, counts, held = [], [], [], 0
        for _, _, s, name in _texts(batches, words, True):
            for h, n in found(s, name):
                sigs.append(h)
                names.append(np.full(h.size, name, np.int64))
                counts += n
                held += h.size
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(names)), pa.array(counts, pa.int32())], schema=schema)
                sigs, names, counts, held = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(names)), pa.array(counts, pa.int32())], schema=schema)

    return docs.select("text").mapInArrow(run, "sig long, cls long, known int")


def _hot(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """Signatures, HOT_MOST at most, that several classes of a sample have: these are shared for certain. The sample decides only where they are counted."""
    some = _emitted(docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0), words, percent, np.zeros(0, np.int64))
    counts = some.select("sig", "cls").distinct().groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST)
    return np.sort(np.array([r.sig for r in counts.orderBy(F.desc("n"), "sig").limit(HOT_MOST).collect()], np.int64))


def _once_a_task(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """cls, its size class, what it must share in that class and in the next (null: nothing lies there), and the text."""
    schema = pa.schema([("cls", pa.int64()), ("c", pa.int32()), ("need", pa.int32()), ("need_next", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, text, s, name in _texts(batches, words, True):
                found = signatures(s, percent)
                yield name, found[0][0], found[0][2], found[1][2] if len(found) > 1 else None, text.decode()

        yield from _batched(rows(), schema, 200)

    return docs.select("text").mapInArrow(run, "cls long, c int, need int, need_next int, text string")


def _linkable(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """cls, text of the classes that share as many fragments with others as a link takes, or have too few for that to be asked."""
    same = Window.partitionBy("sig")
    emitted = _emitted(docs, words, percent, _hot(docs, words, percent))
    shared = emitted.withColumns({"lo": F.min("cls").over(same), "hi": F.max("cls").over(same)}).where("known is not null or lo <> hi")
    counts = shared.groupBy("cls", F.pmod("sig", F.lit(CLASSES)).cast("int").alias("c")).agg(F.sum(F.coalesce("known", F.lit(1))).cast("int").alias("n"))
    able = materialize(counts.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("shared")), "near-able")
    in_class = lambda c, need: F.coalesce((need < 1) | (F.try_element_at("shared", c) >= need), F.lit(False))
    # The list grows with the input, so it is not sent to every task, at any size.
    texts = _once_a_task(docs, words, percent).join(able.hint("merge"), "cls", "left").where(in_class(F.col("c"), F.col("need")) | in_class(F.pmod(F.col("c") + 1, F.lit(CLASSES)), F.col("need_next")))
    return texts.groupBy("cls").agg(F.first("text").alias("text"))


def _segments(texts: DataFrame, words: int) -> DataFrame:
    """cls, n, fragment, segment: the set's shingles in each fragment of the global order."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("fragment", pa.int32()), ("segment", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, value in zip(batch.column("cls").to_pylist(), batch.column("text"), strict=True):
                s = shingles(value.as_buffer().to_pybytes(), words)
                edges = np.searchsorted(s >> np.uint64(64 - FRAGMENTS.bit_length() + 1), np.arange(FRAGMENTS + 1, dtype=np.uint64))
                for f in range(FRAGMENTS):
                    if edges[f] < edges[f + 1]:
                        yield name, s.size, f, s[edges[f] : edges[f + 1]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(cut(batches), schema, 1000)

    return texts.mapInArrow(run, "cls long, n long, fragment int, segment array<bigint>")


def _overlap_bound(a: str, b: str, percent: int):
    """The shared shingle has place i among the shared ones of either set, of which there are n - u: no more than these can overlap."""
    c = lambda x, k: F.col(f"{x}.{k}")
    most = 1 + F.least(c(a, "i"), c(b, "i")) + F.least(c(a, "n") - c(a, "u") - c(a, "i") - 1, c(b, "n") - c(b, "u") - c(b, "i") - 1)
    return (100 * F.least(c(a, "n"), c(b, "n")) >= percent * F.greatest(c(a, "n"), c(b, "n"))) & ((100 + percent) * most >= percent * (c(a, "n") + c(b, "n")))


def _buckets(segments: DataFrame, percent: int) -> DataFrame:
    """tok, cls, n, u (shingles that no other document has), i (place among the others): the prefix of each set, rarest first."""
    tokens = segments.select("cls", F.explode("segment").alias("tok"))
    shared = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(shared, "tok").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"))
    sized = segments.groupBy("cls").agg(F.max("n").alias("n"))
    exact = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1 - F.col("u")
    rows = ordered.join(sized, "cls").withColumn("u", F.col("n") - F.size("toks")).where(exact > 0)
    return rows.select("cls", "n", "u", F.posexplode(F.slice("toks", F.lit(1), exact.cast("int"))).alias("i", "t")).select(F.col("t.tok").alias("tok"), "cls", "n", "u", F.col("i").cast("long").alias("i"))


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) -> those that are linked. The overlap of a pair is the sum of the overlaps of its fragments."""
    left = segments.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("segment").alias("s_a"))
    right = segments.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("segment").alias("s_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("part"))
    whole = partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return whole.where((100 + percent) * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _differences(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs (a, b) -> a, b, n_a, n_b, delta: the shingles that one of them has and the other has not, fragment by fragment."""
    either = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    left = segments.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("segment").alias("s_a"))
    right = segments.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("segment").alias("s_b"))
    both = either.join(left, ["a", "fragment"], "left").join(right, ["b", "fragment"], "left")
    x, y = (F.coalesce(c, F.array().cast("array<bigint>")) for c in ("s_a", "s_b"))
    part = both.select("a", "b", "n_a", "n_b", F.concat(F.array_except(x, y), F.array_except(y, x)).alias("part"))
    return part.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.flatten(F.collect_list("part")).alias("delta"))


def _unlike_pivot(apart: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a pivot, lie in different components, and may still be linked.

    Seen from the pivot h, a set x is its difference Dx from h, and x differs from y by |Dx| + |Dy| - 2 |Dx & Dy| shingles. That is
    few enough without a shared difference only if both are linked to h, and then they lie in one component. Every other linked
    pair shares at least (|Dx| + |Dy| - allowed) / 2 differences; a rarity order, a prefix and bounds on what can be shared at all
    leave few pairs, however many near copies surround a pivot.
    """
    rooted = apart.select(F.col("a").alias("cls"), F.col("b").alias("h"), F.col("n_a").alias("n"), "delta").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = rooted.withColumn("d", F.size("delta").cast("long"))
    each = rooted.select("h", "cls", F.explode("delta").alias("x"))
    shared = each.groupBy("h", "x").agg(F.count("*").alias("df")).where("df > 1")
    lists = each.join(shared, ["h", "x"]).groupBy("h", "cls").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("xs"))
    most = F.expr(f"(n + n * 100 div {percent}) * {100 - percent} div {100 + percent}")
    rows = rooted.drop("delta").join(lists, ["h", "cls"]).withColumns({"s": F.size("xs").cast("long"), "least": F.greatest(F.lit(1), F.col("d") - most)})
    rows = rows.where("s >= least").select("h", "cls", "root", "n", "d", "s", F.posexplode(F.expr("slice(xs, 1, cast(s - least + 1 as int))")).alias("i", "e")).select("h", F.col("e.x").alias("x"), "cls", "root", "n", "d", "s", "i")
    a, b = rows.alias("p"), rows.alias("q")
    c = lambda x, k: F.col(f"{x}.{k}")
    can = 1 + F.least(c("p", "i"), c("q", "i")) + F.least(c("p", "s") - c("p", "i"), c("q", "s") - c("q", "i")) - 1
    enough = (100 + percent) * (c("p", "d") + c("q", "d") - 2 * can) <= (100 - percent) * (c("p", "n") + c("q", "n"))
    found = a.join(b, (c("p", "h") == c("q", "h")) & (c("p", "x") == c("q", "x")) & (c("p", "cls") < c("q", "cls")) & (c("p", "root") != c("q", "root")) & enough)
    return found.select(c("p", "cls").alias("a"), c("q", "cls").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): smallest labels spread along links and jump to their own label's label, until none changes."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jumped = lower.alias("x").join(labels.select(F.col("node").alias("root"), F.col("root").alias("jump")), "root").select("node", "old", F.least("root", "jump").alias("root"))
        new = materialize(jumped, "labels")
        labels = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return labels


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, root) of every class of equal sets that is linked to another."""
    segments = materialize(_segments(_linkable(docs, words, percent), words), "near-segments")
    buckets = materialize(_buckets(segments, percent), "near-buckets")

    head = buckets.groupBy("tok").agg(F.min(F.struct("u", "cls", "n", "i")).alias("h")).select("tok", "h.*")
    star = buckets.alias("x").join(head.alias("y"), F.col("x.tok") == F.col("y.tok")).where((F.col("x.cls") != F.col("y.cls")) & _overlap_bound("x", "y", percent))
    star = star.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.count("*").alias("n"))
    first = materialize(star.groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b")), "near-first")
    linked = materialize(_verified(first, segments, percent), "near-links")
    roots = components(linked)

    rooted = buckets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = materialize(rooted, "near-rooted")
    mixed = rooted.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
    left = rooted.join(mixed, "tok")
    pivots = left.groupBy("tok").agg(F.min(F.struct("u", "cls"))["cls"].alias("pivot"))
    pairs = left.join(pivots, "tok").where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    apart = materialize(_differences(pairs, segments), "near-differences")
    if apart.isEmpty():
        return roots
    near = apart.where((100 + percent) * F.size("delta") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    linked = materialize(linked.unionByName(near), "near-links")
    roots = components(linked)
    rest = materialize(_unlike_pivot(apart, roots, percent), "near-rest")
    if rest.isEmpty():
        return roots
    return components(linked.unionByName(_verified(rest, segments, percent)))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each of docs: doc_id, n_shingles, cls, component_id (the smallest id that links reach)."""
    each = materialize(sets(docs, words), "near-sets")
    roots = links(docs, words, percent)
    named = each.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = named.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = materialize(named, "near-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    out = each.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component: that with the smallest id (a null id comes last; of equal ids the least text). Rows without words all stay."""
    found = near_duplicates(docs.select("doc_id", "text"), words, percent)
    # Rows stand for themselves by id and hash of the text, which is all that can tell them apart here.
    grouped = materialize(found.where("n_shingles > 0").select("doc_id", "cls", "component_id").distinct(), "near-grouped")
    # A component's key is its smallest id, or the class where all its ids are null.
    key = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("c"), F.col("cls")))
    kept = grouped.groupBy(key.alias("key")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "cls")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.cls").alias("__cls"))
    named = _with_class(docs, words)
    empty = named.where("__name is null").select(*docs.columns)
    rows = named.where("__name is not null").join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__name") == F.col("__cls")), "left_semi")
    first = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__name").orderBy("text"))).where("__nth = 1").select(*docs.columns)
    return first.unionByName(empty)


def _with_class(docs: DataFrame, words: int) -> DataFrame:
    """docs with the fingerprint of each set as __name, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [name if s.size else None for _, _, s, name in _texts(iter([batch]), words, False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], [*batch.schema.names, "__name"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__name", T.LongType())]))
