"""Keys of the tables that stand for logs and streams grow as the given tables do; names and percentiles against plain versions."""

import pytest
from pyspark.sql import functions as F

from starlane.operators.graph import percentiles
from starlane.plans import catalogue
from starlane.plans.records import first_name

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "keys"), [("sm05_latest_records", ["did", "rkey"]), ("sm06_distinct_edges", ["target"]), ("flt29_interactions", ["target"]), ("jn16_reply_graph", ["dst"]), ("src17_pool", ["uri"]), ("src03_operations", ["host"])])
def test_keys_grow_in_proportion(spark, name, keys):
    small, large = (catalogue.queries()[name](spark, d).select(*keys).distinct().count() for d in (SMALL, LARGE))
    assert large >= 5 * small > 0


def test_first_names(spark):
    rows = [
        (["dns:a", "at://B.Example "], "old", "b.example"), (["at://  ", "at://c"], None, "c"), (["at://" + "d" * 300], None, "d" * 253),
        (["none"], " Old.Name ", "old.name"), ([], "", None), (None, "x", "x"), ([None, "at://e"], None, "e"), (None, None, None), (["AT://f"], None, None),
    ]
    df = spark.createDataFrame(rows, "aliases array<string>, old string, want string").withColumn("got", first_name(F.col("aliases"), F.col("old")))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]


def test_percentiles_against_sorted_values(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [("a", float(x)) for x in rng.normal(0, 1, 501)] + [("b", float(x)) for x in rng.integers(0, 3, 400)] + [("c", 5.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    got = {r.g: r for r in percentiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert got.keys() == {"a", "b", "c", "e"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g]
        assert r.n == len(own)
        assert (r.q0, r.q50, r.q95, r.q100) == pytest.approx(tuple(np.quantile(own, q) for q in (0, 0.5, 0.95, 1)))
