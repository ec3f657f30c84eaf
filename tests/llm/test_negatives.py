"""Hard negatives against a plain version, on odd rows, with copies and hot labels, and the stream by itself."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlane.llm import negatives


def plain(rows, anchors=lambda i: i % 100 == 0):
    """rows: (id, label, vector); an anchor that stands twice gives its rows twice."""
    good = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, y, v in (r for r in good if anchors(r[0])):
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), i, z == y) for i, z, w in good if i != a or z != y)
        positives = [(i, -s) for s, i, same in scored if same and i != a][:5]
        for p, ps in positives:
            window = [(i, -s) for s, i, same in scored if not same and 80 * ps <= -100 * s <= 100 * ps][:5]
            for rank, (n, ns) in enumerate(window, 1):
                out[a, p, rank, n, ps, ns] += 1
    return out


def got(df, **how):
    return Counter(map(tuple, negatives.mine(df, **how).collect()))


def made(rng, n, dim=8):
    out = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in rng.normal(0, 0.3, dim)]) for i in range(n)]
    out += [(n + i, i % 2, out[10][2]) for i in range(n // 3)]  # copies of one vector under two labels: ties
    return out


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize(("rows", "anchors", "strip"), [(50, 3, 2), (16_384, 4_096, 128)])
def test_against_a_plain_version(spark, monkeypatch, rows, anchors, strip):
    for name, value in (("ROWS", rows), ("ANCHORS", anchors), ("STRIP", strip)):
        monkeypatch.setattr(negatives, name, value)
    data = made(np.random.default_rng(rows), 600)
    assert got(spark.createDataFrame(data, SCHEMA).repartition(3)) == plain(data) != Counter()


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    data = made(rng, 220, 4)
    data += [(None, 1, [0.1] * 4), (1000, None, [0.1] * 4), (1100, 1, None), (1200, 1, [0.1, None, 0.2, 0.3]), (1300, 1, [0.1, float("nan"), 0.1, 0.1]), (1400, 1, [float("inf")] * 4), (1500, 0, []), (1600, 1, [0.5]), (1700, 2, [0.2] * 6), (100, 0, [0.3] * 4), (7, 1, [0.2] * 4), (7, 1, [0.2] * 4), (1800, 9, [0.4] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA + ", number string, id int").repartition(4)
    assert got(df) == plain(data)
    assert negatives.mine(df.limit(0)).count() == 0
    assert got(df.where("vec_id % 100 <> 0")) == Counter()
    assert got(df, label=F.col("label") % 2, anchor=F.col("vec_id") % 50 == 3) == plain([(i, y if y is None else y % 2, v) for i, y, v in data], lambda i: i % 50 == 3)


def test_very_large_components(spark):
    data = [(0, 0, [3e15, 1.0]), (1, 0, [2e15, -1.0]), (2, 0, [1.0, 1.0]), (3, 1, [1.9e15, 5.0]), (4, 1, [1.9e15, 5.0]), (5, 1, [1e3, 1.0])]
    small = [(i, y, [v[0] / 1e9, v[1]]) for i, y, v in data]
    assert got(spark.createDataFrame(small, "vec_id long, label int, embedding array<double>")) == plain(small) != Counter()
    assert all(abs(r.positive_score) < 1 << 63 for r in negatives.mine(spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")).collect())


def test_keys_order_as_bytes():
    rng = np.random.default_rng(1)
    parts = [(int(a), int(b), int(c), int(d), int(e)) for a, b, c, d, e in zip(rng.integers(-5, 5, 500), rng.integers(0, 3, 500), rng.integers(-(1 << 60), 1 << 60, 500), rng.integers(0, 2, 500), rng.integers(-9, 9, 500), strict=True)]
    assert [negatives.unpack(negatives.pack(*p)) for p in parts] == parts
    assert sorted(parts, key=lambda p: (p[0], p[1], -p[2], p[3], p[4])) == sorted(parts, key=lambda p: negatives.pack(*p))


def test_windows_stream():
    """One pair at a time goes in, and what is known by then has come out: no anchor is gathered first."""
    keys = [negatives.pack(1, 0, s, n, i) for s, n, i in [(100, 1, 9), (90, 0, 5), (90, 1, 6), (80, 0, 7), (75, 1, 8), (71, 1, 2), (64, 1, 3), (63, 1, 4)]]
    fed = []

    def feed():
        for k in sorted(keys):
            fed.append(k)
            yield k, None

    stream = negatives.windows(feed())
    assert next(stream) == (1, 5, 1, 6, 90, 90) and len(fed) == 3
    assert list(stream) == [(1, 5, 2, 8, 90, 75), (1, 7, 1, 8, 80, 75), (1, 7, 2, 2, 80, 71), (1, 7, 3, 3, 80, 64)]


def test_cells_hand_on_few_pairs_of_a_large_group_of_copies(spark):
    """4,000 copies, one of them an anchor's near neighbour under each label: no cell hands on more than 5 positives and 25 negatives of an anchor."""
    rng = np.random.default_rng(4)
    v = [float(x) for x in rng.normal(0, 0.3, 8)]
    data = [(i, i % 2, v) for i in range(4000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    found = negatives.mine(df)
    assert found.count() == 40 * 25
    first = found.where("anchor_id = 0 and positive_id = 2").orderBy("rank").collect()
    assert [r.negative_id for r in first] == [1, 3, 5, 7, 9]
