r"""Quality rules: statistics of each text, and lines that repeat over the documents of a host. DataFrame operations only.

Statistics: words (runs of anything but ASCII white space), characters in words, symbols, lines equal to an earlier line, and
words in windows of five that stand twice or more in the text.

Cross-document line frequency: the lines that have a word are normalised (lower case, white space collapsed) and hashed. For each
host (the source) the distinct texts that have a line are counted, so that copies of a text count once. A line is boilerplate if
more than max(LEAST_DOCUMENTS, SHARE of the host's distinct texts) have it, or more than MOST_DOCUMENTS on a host of any size; boilerplate lines are removed, and a document of which
less than DEPLETED of the characters in lines is left is rejected.

Nulls, ties and the like: a null text has no words and so fails; a null source is a host of its own; repeated rows are judged
alike, each for itself; the words and lines of a long text are arrays of one row; an empty table gives an empty result. The operator reads doc_id, source and text; other columns, whatever
their names, are not touched by `quality`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlane.llm.common import SPACE, materialize, plain_words

WINDOW = 5
LEAST_DOCUMENTS, MOST_DOCUMENTS, SHARE, DEPLETED = 20, 1000, 0.10, 0.30
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
SYMBOLS = r"[#*$%&|<>]"


def _host() -> Column:
    return F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))


def _repeats(df: DataFrame) -> DataFrame:
    """w (words) -> n_repeat_words. Only texts in which some window repeats sort their windows."""
    # Words are hashed once, and the hashes of a window together.
    df = df.withColumn("a", F.transform("w", lambda x: F.xxhash64(x)))
    windows = F.transform("a", lambda x, i: F.xxhash64(x, *(F.get(F.col("a"), i + k) for k in range(1, WINDOW))))
    df = df.withColumn("h", F.slice(windows, F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(0)))).drop("a")
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    at = lambda j: F.get(F.col("s"), j)
    same = lambda j: F.coalesce(at(j)["x"] == at(j - 1)["x"], F.lit(False)) | F.coalesce(at(j)["x"] == at(j + 1)["x"], F.lit(False))
    df = df.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("s") - 1), same), lambda j: at(j)["i"]))))
    step = lambda sum_, j: sum_ + F.least(F.lit(WINDOW), F.get(F.col("p"), j + 1) - F.get(F.col("p"), j))
    return df.withColumn("n_repeat_words", F.when(F.col("p").isNull(), F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size("p") - 2), F.lit(WINDOW), step)).cast("long")).drop("h", "s", "p")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, host, th (hash of the text), the statistics, and the lines as (hash, characters)."""
    df = docs.select("doc_id", _host().alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({"th": F.xxhash64("text"), "w": plain_words(F.col("text")), "l": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = _repeats(df)
    return df.select(
        "doc_id",
        "host",
        "th",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("l", lambda x: F.struct(F.xxhash64(F.regexp_replace(F.lower(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))), SPACE, " ")).alias("line"), F.length(x).alias("chars"))).alias("lines"),
    )


def quality(docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE, depleted: float = DEPLETED, most: int = MOST_DOCUMENTS) -> DataFrame:
    """A row for each of docs: doc_id, the statistics, base_failed, line_chars, boilerplate_chars, kept."""
    stats = materialize(statistics(docs).withColumn("row", F.monotonically_increasing_id()), "quality")
    lines = stats.select("row", "host", "th", F.explode("lines").alias("l")).select("row", "host", "th", "l.*")
    texts = stats.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    frequent = lines.select("host", "line", "th").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    boilerplate = frequent.join(texts, "host").where(F.col("n") > F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.lit(share) * F.col("texts")))).select("host", "line")
    removed = lines.join(boilerplate, ["host", "line"]).groupBy("row").agg(F.sum("chars").alias("boilerplate_chars"))
    out = stats.withColumns({"line_chars": F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["chars"]), "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))})
    out = out.drop("lines").join(removed, "row", "left").withColumn("boilerplate_chars", F.coalesce("boilerplate_chars", F.lit(0)).cast("long"))
    left = F.col("line_chars") - F.col("boilerplate_chars") >= F.lit(depleted) * F.col("line_chars")
    return out.withColumn("kept", ~F.col("base_failed") & left).drop("row", "host", "th")
