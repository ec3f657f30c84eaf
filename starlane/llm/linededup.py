r"""Line dedup: lines that many documents hold stay in one of them only.

Texts are split at \n and the lines exploded with their position. A line's key is the line without ASCII white space at its ends
and with A-Z lower-cased; keys of LEAST_CHARS code points or more are hashed (twice 64 bits), the distinct documents of each hash are
counted, and a key that stands in LEAST_DOCUMENTS documents or more loses all its lines but those in the document with the largest
id. What stays of a text is put together again by position.

Skew: documents of a key are made distinct first, spread by (key, document), and counted on the map side. The few keys that stand in
more than a HOT_PARTS-th of all (key, document) pairs, HOT_PARTS of them at most, meet their lines by a broadcast; no other key has
more lines than that to shuffle to one task.

Nulls, ties and the like: a null or empty text is one empty line, and what is left of a null text is an empty one; rows with the same
id are one document, and so are all rows without an id, which comes before every other; repeated rows give repeated rows, each with
the same result; a line as long as a text is a line like any other, and a text is in one task's memory as one row; an empty table gives an empty result.
Other columns pass through, but for those with a name that the operator adds (n_lines, n_dropped), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlane.llm.common import UPPER, materialize

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
HOT_PARTS = 1000
#: ASCII white space, as a set of characters.
BLANK = " \t\n\x0b\x0c\r"


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def _hashes(*what: Column) -> tuple[Column, Column]:
    """128 bits: two hashes of 64 bits that start differently."""
    return F.xxhash64(*what), F.xxhash64(F.lit("second"), *what)


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """d1, d2 (hashes of id and text), doc_id, at (position), k1, k2 (hashes of the key) of every line that is long enough."""
    d1, d2 = _hashes(F.col("doc_id"), F.col("text"))
    at = docs.select(d1.alias("d1"), d2.alias("d2"), "doc_id", F.posexplode(_split(F.col("text"))).alias("at", "line")).withColumn("line", key(F.col("line")))
    k1, k2 = _hashes(F.col("line"))
    return at.where(F.length("line") >= least_chars).select("d1", "d2", "doc_id", "at", k1.alias("k1"), k2.alias("k2"))


def frequent(found: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """k1, k2, n (distinct documents), keeper (the largest id), hot, of the keys that stand in enough documents."""
    pairs = found.select("k1", "k2", "doc_id").distinct()
    often = pairs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_documents)
    often = materialize(often, "line-keys")
    # No more than HOT_PARTS keys can have that share of the pairs of all frequent keys.
    total = often.agg(F.sum("n")).first()[0] or 0
    return often.withColumn("hot", F.col("n") > F.lit(total / HOT_PARTS))


def dropped(found: DataFrame, often: DataFrame) -> DataFrame:
    """d1, d2, gone: the positions of a text's lines that go."""
    hot = F.broadcast(often.where("hot").select("k1", "k2", "keeper"))
    rest = often.where("not hot").select("k1", "k2", "keeper")
    hot_keys = F.broadcast(often.where("hot").select("k1", "k2"))
    met = found.join(hot, ["k1", "k2"]).unionByName(found.join(hot_keys, ["k1", "k2"], "left_anti").join(rest, ["k1", "k2"]))
    return met.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("d1", "d2").agg(F.collect_set("at").alias("gone"))


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs (doc_id, text, ...) with what is left of each text, n_lines (before) and n_dropped."""
    found = materialize(lines(docs, least_chars), "lines")
    gone = dropped(found, frequent(found, least_documents))
    d1, d2 = _hashes(F.col("doc_id"), F.col("text"))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    # The lines are split before the join, so that the lambda below reads a column and doesn't split again for each line.
    whole = docs.select(F.struct(*rest).alias("__row"), _split(F.col("text")).alias("__lines"), d1.alias("d1"), d2.alias("d2")).join(gone, ["d1", "d2"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("gone"))
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda i: F.get(F.col("__lines"), i))), "\n")
    return whole.select(
        *(kept.alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns if c == "text" or c in rest),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
