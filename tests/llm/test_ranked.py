"""Ranked search against scoring every document, on odd rows, in small segments and blocks, and the bounds by themselves."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from starlane.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank, d, -score] += 1
    return out


def got(docs, items, **how):
    return Counter(map(tuple, ranked.search(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect()))


def test_odd_rows(odd, nothing, benchmark, spark):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert got(odd, benchmark) == plain(docs, items)
    assert got(odd, benchmark.union(benchmark), k=2) == plain(docs, items * 2, 2)
    assert got(nothing, benchmark) == Counter() == got(odd, benchmark.limit(0))


def made(rng, n, words=400, long=False):
    """Documents on a few subjects, with copies, ties and one source of near equal texts."""
    subjects = [rng.choice(words, 60, replace=False) for _ in range(6)]
    out = []
    for i in range(n):
        pick = subjects[rng.integers(6)]
        size = int(rng.integers(1, 80)) if not (long and i == 7) else 30_000
        out.append((i, " ".join(f"Wört{pick[min(59, int(rng.exponential(12)))]}" for _ in range(size))))
    out += [(n + i, out[3][1]) for i in range(n // 3)]
    return out


@pytest.mark.parametrize(("block", "segment", "piece"), [(4, 50, 64), (16, 1000, 1 << 20), (128, 16_384, 1 << 20)])
def test_against_scoring_all(spark, monkeypatch, block, segment, piece):
    """Workers get the module's settings with the function, which is why they are read through it."""
    rng = np.random.default_rng(block)
    docs = made(rng, 600, long=True)
    items = [(f"i{j}", " ".join(docs[int(rng.integers(600))][1].split()[:12])) for j in range(15)]
    vocabulary: dict = {}
    asked = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in sorted(set(terms(x)))]) for _, x in items]
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(ranked, "PIECE", piece)
    import pyarrow as pa

    rows = []
    for d, text in docs:
        all_ = [w.decode() for p in ranked.words(text.encode()) for w in p]
        assert all_ == terms(text)
        c = Counter(vocabulary[t] for t in all_ if t in vocabulary)
        rows.append({"doc_id": d, "n": len(all_), "terms": sorted(c), "times": [c[t] for t in sorted(c)]})
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=170)
    df = Counter(t for r in rows for t in r["terms"])
    order = sorted(range(len(vocabulary)), key=lambda t: df[t])
    rank = np.argsort(order)
    weights = np.array([ranked.weight(len(rows), df[t]) for t in order], np.int64)
    own = [np.sort(rank[a]) for a in asked]
    best, scored = [ranked.Best(10) for _ in items], 0
    for number, s in enumerate(ranked._segments(iter(batches), rank, weights, len(rows), sum(r["n"] for r in rows))):
        assert len(s.ids) <= segment
        back, lists = ranked._read(pa.Table.from_batches(ranked._stored(number, s)), weights)
        assert all((getattr(back, n) == getattr(s, n)).all() for n in ("ids", "sizes", "terms", "impacts", "largest"))
        for a, b in zip(own, best, strict=True):
            scored += ranked.search_segment(back, lists, a, b)
        # Summaries are the largest impacts of each block, whose documents are the list's, each once.
        row = np.repeat(np.arange(len(s.ids)), s.sizes)
        assert sorted(lists) == sorted(set(s.terms.tolist()))
        for t in sorted(lists)[::5]:
            one = lists[t]
            assert sorted(one.rows) == sorted(row[s.terms == t])
            for b, (x, y) in enumerate(zip(one.begins, [*one.begins[1:], len(one.rows)], strict=True)):
                assert 0 < y - x <= block
                inside = np.isin(row, one.rows[x:y]) & (s.terms >= t)
                stored = slice(one.summaries[b], [*one.summaries, len(one.coordinates)][b + 1])
                assert dict(zip(one.coordinates[stored].tolist(), one.largest[stored].tolist(), strict=True)) == {u: int(s.impacts[inside & (s.terms == u)].max()) for u in set(s.terms[inside].tolist())}
    want = plain(docs, items)
    assert Counter((i, r, int(d), int(x)) for (i, _), b in zip(items, best, strict=True) for r, (d, x) in enumerate(zip(b.ids, b.scores, strict=True), 1)) == want
    assert scored < 0.9 * sum(sum(1 for r in rows if set(r["terms"]) & set(a.tolist())) for a in asked)  # blocks are skipped


def test_rounds_of_items_and_hot_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = made(rng, 300)
    items = [(j, docs[int(rng.integers(300))][1][:90]) for j in range(12)] + [(None, "wört1 wört2"), (3, docs[0][1])]
    monkeypatch.setattr(ranked, "ITEMS", 4)
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert got(df, it) == plain(docs, items)


def test_bounds_keep_ties_with_smaller_ids(spark):
    """Equal scores in many blocks and segments: the smallest ids win, in whatever order they are met."""
    docs = [(i, "alpha beta") for i in range(400, 0, -1)] + [(None, "alpha beta")] * 3 + [(500, "gamma")]
    items = [("x", "alpha"), ("y", "beta gamma alpha alpha")]
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id string, text string")) == plain(docs, items)


def test_an_index_serves_other_items(spark):
    rng = np.random.default_rng(8)
    docs = made(rng, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = ranked.build(df, {t.encode() for _, x in docs for t in terms(x)})
    known = sorted({t for _, x in docs for t in terms(x)})
    for words in ([" ".join(known[:3]).replace("w", "W"), known[-1]], [docs[9][1]]):
        items = list(enumerate(words))
        found = sorted(tuple(r) for r in index.search([(i, w.encode()) for i, w in items]).collect())
        want = plain(docs, items)
        for i, _ in items:
            best = sorted(((-s, d) for j, d, s in found if j == i))[:10]
            assert Counter((i, r, d, -s) for r, (s, d) in enumerate(best, 1)) == Counter({k: n for k, n in want.items() if k[0] == i})
    with pytest.raises(ValueError, match="not built for"):
        index.search([(0, b"elsewhere")])
