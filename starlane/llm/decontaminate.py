r"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of WINDOW consecutive words (an item of fewer words is one window), a window into shingles of
SHINGLE words (a window of fewer is one shingle). A window stands in a document only if all its shingles do, side by side.

1. Documents are read once. A bitmap of the benchmark's shingles, of bounded size, tells which places of a text may hold one; the
   stretches of text that these places cover (runs) are written, and nothing else: whatever windows a text has lie within its runs.
2. Shingles are ordered by how rare they are, counted in all runs, which is to say in all documents. The rarest shingle of a window
   is its prefix, which suffices; a window of which one shingle stands nowhere is left out.
3. Prefixes are joined with the runs' shingles. The place of the shingle in the window bounds the place of the window in the run, by
   the window's length; what passes is compared word by word with the item-sized window. Items are looked up for windows found.

A benchmark so large that the bitmap fills up makes runs longer, never results wrong. Up to BROADCAST_WINDOWS windows go to every
task, more are joined by shuffle.

Nulls, ties and the like: a null text has no words and is clean; equal rows get equal results, one each; a null id is an id; an item
without words or with a null id is skipped; windows that several items share count for all of them; a very long text is cut like any
other; an empty table gives an empty result, an empty benchmark clean documents. Other columns, whatever they are called, are
ignored by `contamination` and kept by `clean`, which compares rows by (doc_id, hash of text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlane.llm.common import folded_words, materialize

WINDOW, SHINGLE = 10, 3
#: Longs of the bitmap at most (a power of two): one for each shingle up to there.
BITMAP = 1 << 17
BROADCAST_WINDOWS = 100_000


def _shingled(df: DataFrame, words: str, m: int) -> DataFrame:
    """df with toks: the hashes of all runs of m words, in order. Words are hashed once, and the hashes of a run together."""
    hashed = df.withColumn("__a", F.transform(words, lambda x: F.xxhash64(x)))
    toks = F.transform("__a", lambda x, i: F.xxhash64(x, *(F.get(F.col("__a"), i + j) for j in range(1, m))))
    return hashed.withColumn("toks", F.slice(toks, F.lit(1), F.greatest(F.size(words) - m + 1, F.lit(0)))).drop("__a")


def windows(benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """item (the id as a string), window (words): each of an item's windows once."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), folded_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1)))).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(k)).alias("window")).distinct()


def _window_shingles(wins: DataFrame, m: int) -> DataFrame:
    """wid, m (words of the window's shingles), offset, tok."""
    out = None
    for n in range(1, m + 1):
        own = wins.where((F.size("window") >= n) if n == m else (F.size("window") == n))
        part = _shingled(own, "window", n).select("wid", F.lit(n).alias("m"), F.posexplode("toks").alias("offset", "tok"))
        out = part if out is None else out.unionByName(part)
    return out


class _Bitmap:
    """Which hashes may be among those given: a fixed table of bits, made once, and a constant of the plan from then on."""

    def __init__(self, toks: DataFrame):
        size, n = 1, toks.count()
        while size < BITMAP and size < n:
            size *= 2
        self.size = size
        table = [0] * size
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), self._bit(F.col("tok")))
        # At most BITMAP rows, whatever the benchmark.
        for slot, bits in toks.groupBy(self._slot(F.col("tok")).alias("slot")).agg(F.bit_or(bit).alias("bits")).collect():
            table[slot] = bits
        # One literal, folded once.
        self.table = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def _slot(self, tok: Column) -> Column:
        return tok.bitwiseAND(F.lit(self.size - 1)).cast("int")

    def _bit(self, tok: Column) -> Column:
        return F.shiftrightunsigned(tok, 58).cast("int")

    def has(self, tok: Column) -> Column:
        return F.getbit(F.get(self.table, self._slot(tok)), self._bit(tok)) == 1


def _with_runs(df: DataFrame, m: int, bitmap: _Bitmap) -> DataFrame:
    """df (w, runs) with the stretches of words added that shingles of m words cover which may be the benchmark's."""
    places = F.filter(F.transform("toks", lambda x, i: F.when(bitmap.has(x), i)), lambda i: i.isNotNull())
    df = _shingled(df, "w", m).withColumn("__places", places).drop("toks")
    p = F.col("__places")
    starts = F.filter(p, lambda x, j: (j == 0) | (F.get(p, j - 1) < x - m))
    ends = F.filter(p, lambda x, j: F.coalesce(F.get(p, j + 1) > x + m, F.lit(True)))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(F.lit(m).alias("m"), a.alias("start"), F.slice("w", a + 1, b - a + m).alias("words")))
    return df.withColumn("runs", F.concat("runs", runs)).drop("__places")


def _read(docs: DataFrame, toks: DataFrame) -> DataFrame:
    """rid (a row's own), doc_id, th (hash of the text), n_words, runs: a row for each of docs."""
    out = docs.select("doc_id", F.xxhash64("text").alias("th"), folded_words(F.col("text")).alias("w")).withColumn("runs", F.array().cast("array<struct<m:int,start:int,words:array<string>>>"))
    # Lengths of shingles: SHINGLE values at most.
    for m in sorted(r.m for r in toks.select("m").distinct().collect()):
        out = _with_runs(out, m, _Bitmap(toks.where(F.col("m") == m).select("tok").distinct()))
    return out.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "th", F.size("w").cast("long").alias("n_words"), "runs")


def _spots(base: DataFrame, k: int, context: bool) -> DataFrame:
    """tok and, with context, rid, start (of the run), n (its words), place (in the run), lo, around (its words from lo on): a row for each shingle of each run."""
    runs = base.select("rid", F.explode("runs").alias("r")).select("rid", "r.*")
    lo = lambda i: F.greatest(i - (k - 1), F.lit(0))
    out = None
    for m in range(1, SHINGLE + 1):
        part = _shingled(runs.where(F.col("m") == m), "words", m)
        if context:
            each = F.transform("toks", lambda x, i: F.struct(x.alias("tok"), i.alias("place"), lo(i).alias("lo"), F.slice("words", lo(i) + 1, F.lit(2 * k - 1)).alias("around")))
            part = part.select("rid", "start", F.size("words").alias("n"), F.explode(each).alias("s")).select("rid", "start", "n", "s.*")
        else:
            part = part.select(F.explode("toks").alias("tok"))
        out = part if out is None else out.unionByName(part)
    return out


def prefixes(base: DataFrame, wins: DataFrame, toks: DataFrame) -> DataFrame:
    """wid, window, tok (its rarest shingle), offset (its place): of each window whose shingles all stand somewhere."""
    counts = _spots(base, WINDOW, context=False).join(toks.select("tok").distinct(), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("n"))
    rarest = toks.join(counts, "tok", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok", "offset")).alias("p")).where("p.n > 0")
    return wins.join(rarest, "wid").select("wid", "window", F.col("p.tok").alias("tok"), F.col("p.offset").alias("offset"))


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, items (sorted), spans (start, length) of every occurrence, contaminated: a row for each of docs."""
    owned = materialize(windows(benchmark, k), "decon-items")
    wins = materialize(owned.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "decon-windows")
    toks = materialize(_window_shingles(wins, SHINGLE), "decon-shingles")
    base = materialize(_read(docs, toks), "decon-runs")
    found = materialize(prefixes(base, wins, toks), "decon-prefixes")
    # One window may be in very many items, so each table is sent to all tasks by its own count.
    few = lambda df: df.limit(broadcast_windows + 1).count() <= broadcast_windows
    sized = lambda df, table: F.broadcast(df) if few(table) else df

    start, length = F.col("place") - F.col("offset"), F.size("window")
    hits = (
        _spots(base, k, context=True)
        .join(sized(found, wins), "tok")
        .where((start >= 0) & (start + length <= F.col("n")))
        .where(F.slice("around", start - F.col("lo") + 1, length) == F.col("window"))
        .select("rid", "wid", (F.col("start") + start).alias("start"), length.alias("length"))
    )
    hits = materialize(hits, "decon-hits")
    spans = hits.groupBy("rid").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    items = hits.select("rid", "wid").distinct().join(sized(owned.join(wins, "window").select("wid", "item"), owned), "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    out = base.select("rid", "doc_id", "th", "n_words").join(spans, "rid", "left").join(items, "rid", "left")
    return out.select(
        "doc_id",
        "th",
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
        F.col("spans").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    bad = contamination(docs, benchmark, k).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("th").alias("__h")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left_anti")
