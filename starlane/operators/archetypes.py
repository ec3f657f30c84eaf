"""The reusable operators: DataFrame in, DataFrame out. Every order ends in a unique key, so that ties fall the same way each time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.expr import has


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], ties: bool = False) -> DataFrame:
    """The first row of each key in the given order; with ties, all that rank first."""
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def composite_fallback(df: DataFrame, keys: list[str], order: str, groups: list[list[str]], where: Column | None = None, extra: Iterable[Column] = ()) -> DataFrame:
    """The latest row of each key; each group of columns filled, where null, from the latest row in which one of the group is not.

    One aggregation: the largest struct whose first field is the order, among rows that have the group. With where, only rows that
    fit it count for all this, and keys without any are left out; extra aggregates (with names of their own) see every row.
    """
    where = F.lit(True) if where is None else where
    extra, taken = list(extra), {x for g in groups for x in g}
    plain = [c for c in df.columns if c not in keys and c not in taken]
    aggs = [F.max(F.when(where, F.struct(F.col(order).alias("__o"), *plain, *(c for g in groups for c in g)))).alias("__latest")]
    for i, g in enumerate(groups):
        present = F.coalesce(*(F.col(c).cast("string") for c in g)).isNotNull()
        aggs.append(F.max(F.when(where & present, F.struct(F.col(order).alias("__o"), *g))).alias(f"__g{i}"))
    got = df.groupBy(*keys).agg(*aggs, *extra)
    filled = [F.coalesce(F.col(f"__latest.{c}"), F.col(f"__g{i}.{c}")).alias(c) for i, g in enumerate(groups) for c in g]
    own = [c for c in got.columns if c not in keys and not c.startswith("__")]
    return got.where("__latest is not null").select(*keys, *(F.col(f"__latest.{c}").alias(c) for c in plain), *filled, *own)


def topn_else_other(df: DataFrame, label: str, measure: str, n: int, other: str = "Other") -> DataFrame:
    """Labels outside the n largest by total measure become `other`. The list of winners has n rows."""
    top = df.groupBy(label).agg(F.sum(measure).alias("__sum")).orderBy(F.desc("__sum"), label).limit(n).select(F.col(label).alias("__top"))
    return df.join(F.broadcast(top), F.col(label) == F.col("__top"), "left").withColumn(label, F.when(F.col("__top").isNotNull(), F.col(label)).otherwise(F.lit(other))).drop("__top")


def anti_exclude(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def mask_users(df: DataFrame, by: list[str], user: str, mask: str, bits: dict[str, int]) -> DataFrame:
    """Distinct users of each group, in all and for each bit: masks are merged by user first, so that no distinct count expands the rows."""
    merged = df.groupBy(*by, user).agg(F.bit_or(mask).alias("__m"))
    return merged.groupBy(*by).agg(F.count("*").alias("users"), *(F.sum(F.when(has(F.col("__m"), b), 1).otherwise(0)).cast("long").alias(name) for name, b in bits.items()))


def with_total(df: DataFrame, keys: list[str], aggs: list[Column], total: dict[str, str]) -> DataFrame:
    """Groups and one total row (of the keys not in `total`); without keys left the total row stands even over no rows."""
    groups = df.groupBy(*keys).agg(*aggs)
    rest = [k for k in keys if k not in total]
    sums = (df.groupBy(*rest).agg(*aggs) if rest else df.agg(*aggs)).withColumns({k: F.lit(v) for k, v in total.items()})
    return groups.unionByName(sums)


def zero_fill(df: DataFrame, dimension: DataFrame, keys: list[str], columns: Iterable[str]) -> DataFrame:
    out = dimension.join(df, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def trailing_distinct(df: DataFrame, day: str, user: str, n: int) -> DataFrame:
    """day, users: distinct users of the n days that end with each day present. Each row goes to the n days that it counts for, so the join is on equality."""
    days = df.select(day).distinct()
    counted = df.select(user, day).distinct().select(user, F.explode(F.sequence(F.col(day), F.date_add(day, n - 1))).alias(day)).join(days, day, "left_semi").distinct()
    return counted.groupBy(day).agg(F.count("*").alias("users"))


def day_gap(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Days since the row before, of each key; the first of a key is left out."""
    before = F.lag(day).over(Window.partitionBy(*keys).orderBy(day))
    return df.withColumn("gap", F.datediff(F.col(day), before)).where("gap is not null")


def day_n_retention(cohort: DataFrame, activity: DataFrame, user: str, created: str, day: str, ns: Iterable[int]) -> DataFrame:
    """cohort with a flag d<n> for each n: active exactly n days after creation. One equality join on the user."""
    ns = list(ns)
    offset = F.datediff(F.col(day), F.col(created))
    hits = cohort.select(user, created).distinct().join(activity.select(user, day), user).where(offset.isin(ns))
    flags = hits.groupBy(user, created).agg(*(F.max(F.when(offset == n, 1).otherwise(0)).alias(f"d{n}") for n in ns))
    return cohort.join(flags, [user, created], "left").withColumns({f"d{n}": F.coalesce(f"d{n}", F.lit(0)).cast("long") for n in ns})


def within_n_days(cohort: DataFrame, activity: DataFrame, user: str, created: str, day: str, n: int) -> DataFrame:
    """cohort with first_active: the first active day among the n that start with creation, or null."""
    offset = F.datediff(F.col(day), F.col(created))
    first = cohort.select(user, created).distinct().join(activity.select(user, day), user).where(offset.between(0, n - 1)).groupBy(user, created).agg(F.min(day).alias("first_active"))
    return cohort.join(first, [user, created], "left")


def hops(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with step, from 0, in each key."""
    return df.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def detect_changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows where value differs from the row before (before, value), and the first row of each key (before null, nth = 1)."""
    w = Window.partitionBy(key).orderBy(*order)
    out = df.withColumns({"before": F.lag(value).over(w), "nth": F.row_number().over(w)})
    return out.where((F.col("nth") == 1) | (F.col("before") != F.col(value)))


def merge(old: DataFrame, delta: DataFrame, keys: list[str], how: dict[str, str], order: str | None = None) -> DataFrame:
    """A keyed upsert as union and aggregate. how, by column: add, or, min, max, first (what was there stays), last (what comes wins), coalesce (what comes wins unless null).

    The columns that are not keys must be in how. first, last and coalesce look at which side a row comes from, and inside a side at `order`.
    """
    both = old.withColumn("__side", F.lit(0)).unionByName(delta.withColumn("__side", F.lit(1)))
    at = F.struct("__side", *([order] if order else []))
    make = {
        "add": lambda c: F.sum(c),
        "or": lambda c: F.bit_or(c),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
        "first": lambda c: F.min(F.struct(at.alias("a"), F.col(c).alias("v")))["v"],
        "last": lambda c: F.max(F.struct(at.alias("a"), F.col(c).alias("v")))["v"],
        "coalesce": lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("a"), F.col(c).alias("v"))))["v"],
    }
    kinds = dict(old.dtypes)
    return both.groupBy(*keys).agg(*(make[h](c).cast(kinds[c]).alias(c) for c, h in how.items()))


def allocate(rows: DataFrame, places: DataFrame, group: str, keys: list[str], amount: str, place: str, weight: str | None = None) -> DataFrame:
    """Each row's whole amount spread over the places of its group in proportion to their weights (equal ones without any), so that sums stay.

    Every place gets the whole part of its share; what is left goes, one each, to the largest fractions, ties by the place's name. keys and the group name a row;
    rows of groups without places are left out. Whole numbers only, so engines agree.
    """
    weighed = places.withColumn("__w", F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")).where("__w > 0")
    row = Window.partitionBy(group, *keys)
    each = rows.join(weighed, group).withColumn("__all", F.sum("__w").over(row))
    each = each.withColumns({"__q": F.expr(f"`{amount}` * __w div __all"), "__f": F.expr(f"`{amount}` * __w % __all")})
    each = each.withColumns({"__left": F.col(amount) - F.sum("__q").over(row), "__i": F.row_number().over(row.orderBy(F.desc("__f"), place))})
    return each.withColumn(amount, F.col("__q") + F.when(F.col("__i") <= F.col("__left"), 1).otherwise(0)).drop("__w", "__all", "__q", "__f", "__left", "__i")


def null_aware_anti(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is NOT IN others: all if others is empty, none if it holds a null, and none with a null key unless it is empty.

    An anti join on equality and one row of counts, so neither side is broadcast whatever its size.
    """
    held = others.agg(F.count("*").alias("__rows"), F.count(key).alias("__named"))
    apart = df.join(others.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(held))
    return apart.where((F.col("__rows") == 0) | ((F.col("__rows") == F.col("__named")) & F.col(key).isNotNull())).select(*df.columns)


def rank_metrics(df: DataFrame, score: str, hit: str, key: str, ks: list[int]) -> DataFrame:
    """k, precision, recall, lift of the k best by score. Only the best max(ks) rows are ordered."""
    totals = df.agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"))
    top = df.orderBy(F.desc(score), key).limit(max(ks))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))
    found = ranked.select(F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))).alias("k"), F.col(hit).cast("long").alias("h")).groupBy("k").agg(F.sum("h").alias("found"), F.count("*").alias("seen"))
    precision = F.col("found") / F.col("seen")
    return found.crossJoin(F.broadcast(totals)).select("k", precision.alias("precision"), (F.col("found") / F.nullif("hits", F.lit(0))).alias("recall"), (precision / F.nullif(F.col("hits") / F.col("n"), F.lit(0.0))).alias("lift"))
