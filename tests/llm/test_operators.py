"""Each operator on odd rows, on none, and against a plain version of itself."""

import base64
import gzip
import hashlib
import io
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starlane.llm import chat, decontaminate, language, licenses, mixing, near, quality, sharding, toxicity, warc
from starlane.llm.common import finished, materialize, scratch_tables

PLAIN = re.compile("[^\x20\x09-\x0d]+")
FOLDED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op1


def test_shard_odd_rows(odd, nothing):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            text = texts[r.doc_id]
            assert r.size == (len(text.encode()) if text is not None else 0) + 1
            assert r.text_crc32 == (zlib.crc32(text.encode()) if text is not None else None)
    assert sharding.shard(nothing, 4).count() == 0


def test_shard_is_balanced_and_moves_little():
    rng = np.random.default_rng(3)
    cells = [(c, -1, int(b)) for c, b in enumerate(rng.lognormal(10, 0.5, 20000))]
    total = sum(b for *_, b in cells)
    a, b = sharding.walk(cells, 16), sharding.walk(cells, 17)
    load = Counter()
    for c, k, size in cells:
        load[a[c, k][0]] += size
    assert max(load.values()) <= (1 + sharding.SLACK) * total / 16 + max(b for *_, b in cells)
    assert min(load.values()) >= 0.97 * total / 16
    moved = sum(size for c, k, size in cells if a[c, k][0] != b[c, k][0]) / total
    assert moved < 2.5 / 17


def test_shard_splits_one_hot_id(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 50).alias("text"))
    sizes = [r["sum(size)"] for r in sharding.shard(rows, 4).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 4 and max(sizes) < 1.1 * min(sizes)


def test_shard_splits_many_small_rows_of_one_id(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") >= 3000, F.lit("y" * 500)).alias("text"))
    got = sharding.shard(rows, 4)
    assert got.where("doc_id is null").select("shard").distinct().count() > 1
    assert sorted(r.slot for r in got.where("shard = 0").collect()) == list(range(got.where("shard = 0").count()))


def test_shard_splits_cells_far_below_a_shard(spark):
    """An id with a two-hundredth of all rows is many windows, none with more than some thousandths."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 200 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("xyz").alias("text"))
    got = sharding.shard(rows, 4)
    assert got.where("doc_id = 7").select("shard", "home_shard").distinct().count() > 4
    assert got.select("shard", "slot").distinct().count() == 40_000


def test_ring_walk_against_a_plain_one():
    """Key by key: clockwise from its place, past every point whose shard is full."""
    rng = np.random.default_rng(6)
    for shards, n in ((3, 40), (5, 300)):
        cells = [(int(c), -1, int(b)) for c, b in zip(rng.choice(1 << sharding.CELL_BITS, n, replace=False), rng.integers(1, 400, n), strict=True)]
        points = sorted((sharding._place("shard", s, v), s) for s in range(shards) for v in range(8))
        cap, load, want = 1.05 * sum(b for *_, b in cells) / shards, [0] * shards, {}
        place = lambda c: c << 64 - sharding.CELL_BITS
        for c, k, size in sorted(cells, key=lambda x: (-x[2].bit_length(), place(x[0]))):
            clockwise = sorted(points, key=lambda p: (p[0] - place(c)) % (1 << 64))
            free = [s for _, s in clockwise if load[s] + size <= cap]
            to = free[0] if free else min(range(shards), key=lambda s: (load[s], s))
            load[to] += size
            want[c, k] = to, clockwise[0][1]
        assert sharding.walk(cells, shards, 8, 0.05) == want


def test_shard_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert Counter(map(tuple, sharding.shard(docs).collect())) == Counter(map(tuple, sharding.shard(docs).collect()))


# --- op2


def sets(texts, k):
    out = []
    for t in texts:
        w = PLAIN.findall((t or "").translate(LOW))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute_components(ids, texts, k, percent):
    s, root = sets(texts, k), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((ids[i], len(s[i]), least.get(find(i)) if s[i] else ids[i]) for i in range(len(s)))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_near_odd_rows(odd, k, percent):
    rows = odd.collect()
    want = brute_components([r.doc_id for r in rows], [r.text for r in rows], k, percent)
    got = near.near_duplicates(odd, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == want


def mutated(rng, base, vocabulary, edits):
    words = list(base)
    for _ in range(edits):
        i, kind = rng.integers(len(words)), rng.integers(3)
        if kind == 0:
            words[i] = vocabulary[rng.integers(len(vocabulary))]
        elif kind == 1 and len(words) > 2:
            del words[i]
        else:
            words.insert(i, vocabulary[rng.integers(len(vocabulary))])
    return " ".join(words)


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_near_against_brute_force(spark, k, percent, seed):
    """A large group of near copies, small ones, one common passage, copies."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [vocabulary[i] for i in rng.integers(400, size=12)]
    texts = []
    for size, length, most in [(60, 80, 6), (10, 30, 3), (10, 12, 2), (8, 4, 1), (30, 25, 25)]:
        base = [vocabulary[i] for i in rng.integers(400, size=length)]
        texts += [mutated(rng, base, vocabulary, int(rng.integers(most + 1))) for _ in range(size)]
    texts += [" ".join(passage + [vocabulary[i] for i in rng.integers(400, size=3)]) for _ in range(30)] + texts[:15]
    ids = list(range(100, 100 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    got = near.near_duplicates(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(ids, texts, k, percent)


def test_near_keeps_sets_that_agree_in_empty_fragments(spark):
    """Eight words that lie in few fragments, and the same with two words more, alone in their class: both must pass the filter."""
    words = [f"a48x{i}" for i in range(10)]
    texts = [" ".join(words[:8]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(docs, 1, 80).collect())
    assert got == brute_components([0, 1], texts, 1, 80)


def test_signatures_find_every_linked_pair():
    """Each pair alone in its table: both sets must pass the filter."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)

    def passes(x, other):
        return any(need < 1 or np.isin(h, other).sum() >= need for _, h, need in x)

    for percent in (80, 90):
        linked = 0
        for n in [*range(1, 61)] * 80 + [133, 700] * 40:
            a = np.unique(draw(n))
            most = near.most_different(n, n * 100 // percent, percent)
            gone = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([a[rng.permutation(n)[gone:]], draw(int(rng.integers(0, most - gone + 1)))]))
            both = np.intersect1d(a, b, assume_unique=True).size
            if both and 100 * both >= percent * (a.size + b.size - both):
                linked += a.size != both or b.size != both
                x, y = near.signatures(a, percent), near.signatures(b, percent)
                assert passes(x, np.concatenate([h for _, h, _ in y])) and passes(y, np.concatenate([h for _, h, _ in x]))
        assert linked > 1000


def test_near_links_a_text_and_one_word_more(spark):
    words = [f"q{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words[:11])), (2, " ".join(words))], "doc_id long, text string")
    assert {r.component_id for r in near.near_duplicates(docs, 5, 80).collect()} == {1}
    assert near.one_of_each(docs, 5, 80).count() == 1


def test_hot_signatures_change_nothing(spark, monkeypatch):
    """With every text in the sample, what two have is counted in place; the result stays."""
    monkeypatch.setattr(near, "HOT_SAMPLE", 1)
    monkeypatch.setattr(near, "HOT_LEAST", 2)
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for size, length in [(30, 60), (10, 9), (5, 200)]:
        base = [vocabulary[i] for i in rng.integers(300, size=length)]
        texts += [mutated(rng, base, vocabulary, int(rng.integers(4))) for _ in range(size)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert near._hot(docs, 3, 90).size > 0
    got = near.near_duplicates(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(list(range(len(texts))), texts, 3, 90)


def test_near_empty_and_one_of_each(odd, nothing):
    assert near.near_duplicates(nothing).count() == 0
    kept = near.one_of_each(odd, 3, 80)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == {1: 1, 4: 1, 5: 1, None: 2, 7: 1, 8: 1, 9: 1, 10: 1}
    assert near.one_of_each(nothing).count() == 0


def test_finished_leaves_the_result_only(spark, odd):
    """Also with another run's tables open around it, which stay."""
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    with scratch_tables() as outer:
        kept = near.materialize(odd.select("doc_id"), "outer")
        before = set(os.listdir(base))
        out = finished(lambda: sharding.shard(odd, 4), "result")
        assert [n.split("-")[0] for n in set(os.listdir(base)) - before] == ["result"]
        assert len(outer) == 1 and kept.count() == out.count() == odd.count()


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = ("alpha beta gamma delta " * 500).encode()
    whole = near.word_hashes(text)
    monkeypatch.setattr(near, "BLOCK", 100)
    assert (near.word_hashes(text) == whole).all()


# --- op3


def brute_contamination(docs, items, k=10):
    words = lambda t: FOLDED.findall((t or "").translate(LOW))
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - k + 1)):
                wins[tuple(w[i : i + k])].add(item)
    out = Counter()
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for win, who in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= who
        out[d, len(w), len(hit), tuple(sorted(found)), bool(hit)] += 1
    return out


@pytest.mark.parametrize(("bitmap", "few"), [(1 << 17, 100), (1, 0)])
def test_decontaminate_both_ways(odd, benchmark, monkeypatch, bitmap, few):
    """With a broadcast and a sparse bitmap, and with joins and one long of bits only."""
    monkeypatch.setattr(decontaminate, "BITMAP", bitmap)
    want = brute_contamination([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in benchmark.collect()])
    got = decontaminate.contamination(odd, benchmark, broadcast_windows=few).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want
    assert sum(v for k, v in want.items() if k[-1]) == 5


def test_a_window_that_very_many_items_share(spark):
    """One window, one document and 5,000 items: the items' table is judged by its own size, not by that of the windows."""
    text = "one two three four five six seven eight nine ten"
    items = spark.range(5000).select(F.format_string("i%05d", "id").alias("item_id"), F.lit(text).alias("text"))
    docs = spark.createDataFrame([(1, f"so {text} it is"), (2, "nothing here"), (3, text)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items, broadcast_windows=100).collect()}
    assert got == {1: (10, 5000), 2: (0, 0), 3: (10, 5000)}


def test_decontaminate_against_brute_force(spark):
    rng = np.random.default_rng(12)
    words = [f"v{i}" for i in range(6)]
    line = lambda n: " ".join(words[i] for i in rng.integers(6, size=n))
    items = [(i, line(int(rng.integers(1, 16)))) for i in range(12)]
    docs = [(i, line(int(rng.integers(0, 60))) + " " + (items[int(rng.integers(12))][1] if i % 2 else "")) for i in range(60)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5).collect()
    want = brute_contamination(docs, [(str(i), t) for i, t in items], 5)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want


def test_decontaminate_cleans(odd, nothing, benchmark):
    left = decontaminate.clean(odd, benchmark)
    assert left.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 4, 5, 7, 9, 10]
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert decontaminate.clean(odd, benchmark.limit(0)).count() == odd.count()


# --- op4


def brute_targets(sizes, share, cap, weights):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = total / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            total -= out[s]
        open_ -= full
    return out


def test_mix_odd_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += len(PLAIN.findall(r.text or ""))
    want = brute_targets(sizes, 1.5, 2.0, (5, 2, 1))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert len(rows) == odd.count() and mixing.mix(nothing).count() == 0


def test_mix_comes_near_its_targets(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.sum("size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 2 * r.most for r in by)
    assert sum(r.taken for r in by) <= 1.5 * sum(r["size"] for r in by)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and sum(r.taken for r in by) == rows.select(F.sum(mixing.word_count(F.col("text")))).first()[0]


def test_mix_splits_rows_of_one_id_and_size(spark, monkeypatch):
    """A third of the rows have no id and one size: they are cells of many tasks, and every row still has a place of its own."""
    monkeypatch.setattr(mixing, "HOT_LEAST", 500)
    n = 6000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"), F.when(F.col("id") % 3 == 0, "a b c").otherwise(F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 5 + 1).cast("int")))).alias("text")).repartition(4)
    queued = materialize(mixing.queue_keys(df, mixing.word_count(F.col("text"))).withColumn("__rid", F.monotonically_increasing_id()), "queue")
    cells = mixing._split_hot(queued).groupBy("__key", "__cell").agg(F.count("*").alias("n"), F.min("__order").alias("a"), F.max("__order").alias("b")).collect()
    assert max(r.n for r in cells) < 60 and sum(r.n for r in cells) == n
    by = defaultdict(list)
    for r in cells:
        by[r["__key"]].append((tuple(r["__cell"]), r.a, r.b))
    for each in by.values():
        each.sort()
        assert all(x[2] <= y[1] for x, y in zip(each, each[1:], strict=False))  # cells sort as their shuffle keys do
    rows = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 12 for r in rows)
    split = Counter((r.doc_id, r.taken) for r in mixing.mix(df, keep_columns=False).collect())
    monkeypatch.setattr(mixing, "HOT_LEAST", 1 << 30)
    assert split == Counter((r.doc_id, r.taken) for r in mixing.mix(df).collect())


def test_mix_keeps_columns_of_its_own_names(odd):
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert {r["size"] for r in mixing.mixed_rows(odd).collect()} == {"s"}


# --- op5


def test_warc_odd_rows(spark):
    rows = [(1, "http://a/", "same"), (5, None, "same"), (None, "x y\r\nz", "same"), (3, "http://b/?q=ü", None), (4, "", ""), (6, "u", "é" * 300000), (6, "u", "é" * 300000), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least in (0, 10):
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages, least).collect())
        want, heads = Counter(), {}
        for p, _, h in rows:
            if p is not None:
                heads[h or ""] = max(p, heads.get(h or "", p))
        for p, _, h in rows:
            data = (h or "").encode()
            head = heads.get(h or "") if len(data) >= least else None
            again = head is not None and p != head
            want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", head if again else None] += 1
        assert got == want
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def archive(*payloads):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    return b"".join(warc.record(i, f"http://x/{i}", p, len(p), digest(p), None, False) for i, p in enumerate(payloads))


def test_warc_reader_streams_members_and_is_plain_gzip():
    data = archive(b"", b"a" * 200_000, bytes(range(256)) * 10)
    got = list(warc.read_records(io.BytesIO(data), keep_payload=True))
    assert [len(r["payload"]) for r in got] == [0, 200_000, 2560]
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    small = warc.CHUNK
    try:
        warc.CHUNK = 7
        assert list(warc.read_records(io.BytesIO(data), keep_payload=True)) == got
    finally:
        warc.CHUNK = small


@pytest.mark.parametrize("harm", ["cut", "digest", "length", "flip"])
def test_warc_reader_finds_damage(harm):
    data = archive(b"hello world", b"second")
    if harm == "cut":
        data = data[:-5]
    elif harm == "flip":
        data = data[:60] + bytes([data[60] ^ 255]) + data[61:]
    else:
        text = gzip.decompress(data)
        text = text.replace(b"hello", b"jello") if harm == "digest" else re.sub(rb"(msgtype=response\r\nContent-Length: )\d+", rb"\g<1>5", text, count=1)
        data = gzip.compress(text[: text.index(b"WARC/1.1", 5)])
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data)))


# --- op6


def brute_statistics(templates, text):
    """The longest run ending at each word that some template has."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    out = []
    for end in range(1, len(text) + 1):
        n = 0
        while n < end and tuple(text[end - n - 1 : end]) in runs:
            n += 1
        out.append(n)
    return out


def test_suffix_automaton_against_all_substrings():
    rng = np.random.default_rng(2)
    for _ in range(30):
        templates = [rng.integers(0, 4, rng.integers(1, 12)).tolist() for _ in range(3)]
        automaton = licenses.SuffixAutomaton(templates)
        text = rng.integers(0, 4, 40).tolist()
        want = brute_statistics(templates, text)
        ends = {p: n for p, n, _ in automaton.matches(text)}
        cut = [i for i in range(40) if want[i] >= licenses.SEED and (i == 39 or want[i + 1] <= want[i])]
        assert ends == {i: want[i] for i in cut}
        for place, length, state in automaton.matches(text):
            run = text[place - length + 1 : place + 1]
            assert automaton.ends[state] == {(name, end) for name, t in enumerate(templates) for end in range(length - 1, len(t)) if t[end - length + 1 : end + 1] == run}


def brute_spans(template, text):
    """All chains of maximal matches of one template, the best at each match; then by words covered, where the text is free."""
    runs, want = [], brute_statistics([template], text)
    for end, n in enumerate(want):
        if n >= licenses.SEED and (end + 1 == len(text) or want[end + 1] <= n):
            runs.append((end - n + 1, end, [p for p in range(n - 1, len(template)) if template[p - n + 1 : p + 1] == text[end - n + 1 : end + 1]]))
    chains = []
    for first, last, places in runs:
        now = []
        for place in places:
            start = place - (last - first)
            before = [c for c in chains if c[1] < first and first - c[1] <= licenses.GAP and c[2] < start]
            best = max(before, key=lambda c: (c[3], c[1], c[0]), default=(first, 0, 0, 0))
            now.append((best[0], last, place, best[3] + last - first + 1))
        chains += now
    out = []
    for a, b, _, covered in sorted(set(chains), key=lambda c: (-c[3], c[1] - c[0], c[0])):
        share = licenses.COVER_SHORT if len(template) <= licenses.SHORT else licenses.COVER
        if covered >= share * len(template) and all(b < x or y < a for x, y, _ in out):
            out.append((a, b, covered))
    return sorted(out)


def test_license_chains_against_brute_force():
    rng = np.random.default_rng(8)
    found = 0
    for _ in range(300):
        template = [b"t%d" % x for x in rng.integers(0, 9, int(rng.integers(8, 40)))]
        text = []
        for _ in range(int(rng.integers(1, 5))):
            a = int(rng.integers(len(template)))
            text += template[a : a + int(rng.integers(3, 40))] + [b"x%d" % x for x in rng.integers(0, 3, int(rng.integers(0, 40)))]
        want = brute_spans(template, text)
        got = licenses.spans(text, (("l", b" ".join(template).decode()),))
        assert [x[1:4] for x in got] == want
        found += len(want)
    assert found > 200


@pytest.mark.parametrize("between", [0, 10, 29, 40])
def test_a_license_that_stands_twice_is_two_spans(between):
    for template in (licenses.TEMPLATES[1][1], licenses.TEMPLATES[2][1]):
        once = licenses.words(template.encode())
        text = once + [b"foo"] * between + once
        assert [x[1:3] for x in licenses.spans(text) if x[3] == len(once)] == [(0, len(once) - 1), (len(once) + between, len(text) - 1)]


def test_one_notice_is_one_span():
    """Templates of one license share their wording; each place is named once for a label, by what covers most."""
    for text in ("code under the MIT license", licenses.TEMPLATES[1][1], "see the MIT license, and this is released under the MIT license too"):
        found = licenses.spans(licenses.words(text.encode()))
        every = licenses.template_spans(licenses.words(text.encode()))
        for label in {x[0] for x in every}:
            own = [x for x in found if x[0] == label]
            assert all(a[2] < b[1] for a, b in zip(own, own[1:], strict=False))
            assert all(any(x[1] <= y[2] and y[1] <= x[2] and x[3] >= y[3] for x in own) for y in every if y[0] == label)


def test_license_templates_as_a_table(spark):
    table = spark.createDataFrame([("own", "all of this belongs to nobody at all"), ("own", None), (None, "x y z"), ("none", "  ")], "label string, text string")
    docs = spark.createDataFrame([(1, "Now ALL of this, belongs to nobody at all."), (2, "belongs to nobody"), (3, "w " * 300_000 + "all of this belongs to nobody at all")], "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.n_words) for r in licenses.scan(docs, table).collect()} == {1: ("own", 9), 2: ("", 3), 3: ("own", 300_008)}


def test_license_scan(odd, nothing, spark):
    rows = {r.doc_id: r for r in licenses.scan(odd.where("doc_id is null or doc_id <> 8")).collect() if r.doc_id is not None or r.n_words}
    assert (rows[None].labels, rows[None].base_labels, rows[None].n_base, rows[None].first_word) == ("mit", "mit", 1, 3)
    assert rows[5].n_words == 0 and rows[5].labels == "" and rows[5].score == 0 and rows[5].first_word is None
    text = "x " * 50 + licenses.TEMPLATES[4][1].replace("compliance", "full compliance") + " y MIT  license, mit-license; commit license. Licensed under CC BY-NC 4.0"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "apache,cc-by-nc,mit" and r.base_labels == "mit" and r.n_base == 2 and 0.9 < r.score <= 1
    assert licenses.scan(nothing).count() == 0


# --- op7


def test_language(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    got = language.identify(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (4, 5, 9)} == {"und"}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert language.identify(nothing).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(nothing)).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "\u00bd \u2163 12"), (2, "\u00bd a"), (3, "_1_")], "doc_id long, text string")
    model = language.Model(np.stack([language.counts("the dog")]), ["en"])
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()} == {1: "und", 2: "en", 3: "und"}


def test_language_family_first():
    x = np.vstack([language.counts(t) for t in ["der hund und die katze"] * 3 + ["the dog and the cat"] * 3 + ["le chien et le chat"] * 3])
    model = language.Model(x.astype(np.float32), ["de"] * 3 + ["en"] * 3 + ["fr"] * 3)
    assert model.families == [["de", "en"], ["fr"]]
    assert [p[0] for p in model.predict(x[[0, 3, 6]])] == ["de", "en", "fr"]


def test_letters_are_counted_in_blocks(monkeypatch):
    text = "Ärger über die Straße, " * 500
    whole = language.counts(text)
    for size in (1, 2, 7, 4096):
        monkeypatch.setattr(language, "BLOCK", size)
        assert (language.counts(text) == whole).all()
    assert language.counts("").sum() == 0 and language.counts("a").sum() == 1


# --- op8


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(2, 2))
    for n in (1, 2, 5):
        u = rng.normal(size=n)
        padded = np.full((2, 7), -30.0)
        padded[0, :n] = u
        got = toxicity.forward_backward(padded, np.array([n, 1]), trans)[2][0, :n]
        mass, ones = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(u[i] for i in range(n) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            mass += p
            ones += p * np.array(y)
        assert got == pytest.approx(ones / mass, abs=1e-9)


def test_pieces_give_what_whole_texts_give():
    rng = np.random.default_rng(4)
    field = toxicity.Field()
    field.trans = rng.normal(size=(2, 2))
    scores = [rng.normal(0, 3, n) for n in (1, 0, 63, 64, 65, 128, 1, 1000, 0, 7)]
    for got, u in zip(field.marginals(scores), scores, strict=True):
        want = toxicity.forward_backward(u[None], np.array([u.size]), field.trans)[2][0] if u.size else u
        assert got == pytest.approx(want, abs=1e-9)
    assert [p.size for p in field.marginals([np.zeros(0)])] == [0]
    assert field.marginals([rng.normal(size=1_000_000)])[0].shape == (1_000_000,)


def test_toxicity(spark, odd, nothing):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, field).join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)
    spans = [r.text[s["first"] : s["last"]] for r in rows for s in r.offsets]
    assert {"moron", "trash", "scum"} <= set(" ".join(spans).lower().split())
    got = toxicity.score(odd, field).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = toxicity.keep_clean(odd, field)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} <= {"x"}
    assert toxicity.score(nothing, field).count() == 0


def test_toxicity_trains_on_as_many_clean_pieces_as_asked(spark, monkeypatch):
    d, seen = "/root/testdata/sf0.001", []
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    monkeypatch.setattr(toxicity.Field, "train", lambda self, pieces: seen.append(Counter(bool(t.any()) for _, t in pieces)))
    monkeypatch.setattr(toxicity.Field, "calibrate", lambda self, *_: None)
    for clean in ((0, 3), (0, 1 << 30), toxicity.CLEAN):
        toxicity.fit(docs, labels, clean=clean)
    few, every, usual = seen
    assert few[False] == 3 < every[False] and few[True] == every[True] > 0
    assert usual[False] == min(every[False], 2 * usual[True] + 500)


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()} == {0}


# --- op9


def brute_quality(text):
    text = text or ""
    w = PLAIN.findall(text)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    lines = [x for x in text.split("\n") if PLAIN.search(x)]
    repeated = {p for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_limit_does_not_rise_with_the_host(spark):
    """A line in 60 of 1,000 texts is below the share, but above a fixed count."""
    rows = [(i, ("same line in many texts of this host here\n" if i < 60 else "") + f"its own words {i} a b c d e f g", "h") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = lambda **how: quality.quality(docs, **how).where("boilerplate_chars > 0").count()
    assert gone() == 0 and gone(most=50) == 60 and gone(most=60) == 0


def test_quality_statistics(odd, spark, nothing):
    extra = spark.createDataFrame([(20, "a b c d e f\na b c d e f\n\nx é# $ç\n a b c d e f", "en", "a"), (21, "a " * 7, "en", None)], "doc_id long, text string, lang string, source string")
    docs = odd.select("doc_id", "text", "lang", "source").unionByName(extra)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality(docs).collect())
    assert got == Counter((r.doc_id, *brute_quality(r.text)) for r in docs.collect())
    assert quality.quality(nothing).count() == 0


def test_columns_with_names_of_the_operators_own(spark, odd):
    """What an operator adds may be the name of a column that it does not read."""
    clashing = odd.selectExpr("doc_id", "text", "lang", "source", "1 AS n_words", "2 AS kept", "3 AS host", "4 AS line", "5 AS lines", "6 AS row", "7 AS boilerplate_chars")
    want = Counter(tuple(r) for r in quality.quality(odd).select("doc_id", "n_words", "kept").collect())
    assert Counter(tuple(r) for r in quality.quality(clashing).select("doc_id", "n_words", "kept").collect()) == want
    pages = spark.createDataFrame([(1, "u", "<a>", 5, "x", b"y"), (2, None, "<a>", None, None, None)], "page_id long, url string, html string, payload_bytes int, record_type string, refers_to binary")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages, least=0).collect()}
    assert got == {1: (3, "revisit", 2), 2: (3, "response", None)}


def test_long_texts_in_every_operator(spark):
    """A text of a million characters beside short ones."""
    words = [f"w{i % 977}x{i % 31}" for i in range(120_000)]
    text = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)) + "\nreleased under the MIT License"
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, "short one", "en", "a"), (3, text + " tail", "en", "b")], "doc_id long, text string, lang string, source string")
    n = len(PLAIN.findall(text))
    item = " ".join(words[5000:5030])
    found = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()}
    assert found[1].contaminated and found[3].contaminated and not found[2].contaminated
    assert {r.doc_id: r["size"] for r in mixing.mix(docs).collect()} == {1: n, 2: 2, 3: n + 1}
    scanned = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert scanned[1].labels == "mit" and scanned[1].first_word == n - 2 == scanned[1].last_word
    assert {r.doc_id: r.n_words for r in quality.quality(docs).collect()} == {1: n, 2: 2, 3: n + 1}
    assert all(r.lang_pred == "en" for r in language.identify(docs, language.fit(docs)).collect()) or not language.fit(docs).families
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    back = chat.read_back(chat.layout(turns)).first()
    assert back.loss_chars == len(text) and back.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_quality_rejects_depleted_documents(spark):
    own = " ".join(f"own{i}" for i in range(20))
    common = "this line of the footer stands in nearly every document of the host and says nothing"
    rows = [(i, f"{common} \n{own.replace('own', f'own{i}x')}", "h") for i in range(30)] + [(100, f"{common}\n {common.upper()}", "h"), (101, common, "other")] + [(200 + i, own, "copies") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not kept.pop(100) and all(kept.values())


# --- op10


def test_chat_round_trip(spark):
    tricky = "a\\<|im_end|>\n<|im_start|>assistant\\\\ <\\| <|x"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "user", None), (1, 3, "assistant", "é"), (1, 3, "assistant", "é"), (2, None, None, "x"), (None, 0, "sys\ntem\\", ""), (3, 0, "assistant", ""), (1, 4, "user", "bye")]
    turns = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    laid = chat.layout(turns)
    got = {r.conv_id: r for r in chat.read_back(laid).collect()}
    key = lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {(r.conv_id, r.example): r for r in chat.rendered(laid).collect()}
    assert set(whole) == {(1, 1), (1, 2), (1, 3), (3, 1)}
    assert whole[1, 3].context.count(chat.START) == 4 and whole[3, 1].context == ""
    for r in chat.examples(laid).where("conv_id = 1").collect():
        text = whole[1, r.example].context + whole[1, r.example].reply
        assert len(text) == r.end and chat.unescape(text[r.loss_start : r.loss_end]) in (tricky, "é")
    assert got[1].example_chars == sum(len(w.context) + len(w.reply) for k, w in whole.items() if k[0] == 1)
    assert chat.read_back(chat.layout(turns.limit(0))).count() == 0


def test_chat_query_reads_examples_from_files(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"said {i} <|x") for i in range(9)] + [(2, 0, "user", "alone")]
    laid = chat.layout(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    with scratch_tables() as written:
        (got,) = chat.read_back(laid).where("conv_id = 1").collect()
    (path,) = written
    examples = {r.example: r for r in spark.read.parquet(path).where("conv_id = 1").collect()}
    segments = [r.segment for r in laid.where("conv_id = 1").orderBy("place").collect()]
    assert set(examples) == {1, 2, 3, 4, None}
    for k in (1, 2, 3, 4):
        e = examples[k]
        assert e.context == "".join(segments[: 2 * k - 1]) and e.reply == segments[2 * k - 1]
        assert chat.unescape((e.context + e.reply)[e.loss_start : e.loss_end]) == f"said {2 * k - 1} <|x"
    assert examples[None].context == "".join(segments) and examples[None].reply is None
    assert (got.n_examples, got.formatted_chars) == (4, sum(map(len, segments))) and got.example_chars == sum(len(examples[k].context + examples[k].reply) for k in (1, 2, 3, 4))


def test_chat_reading_notices_a_context_that_is_cut():
    turn = lambda role, text: f"{chat.START}{role}\n{text}{chat.END}"
    u, a = turn("user", "q"), turn("assistant", "r")
    start = len(u) + len(a) - len(chat.END) - 1
    good = [(1, 1, u, a, start, start + 1), (1, 2, u + a + u, a, start + len(u + a), start + len(u + a) + 1)]
    names, schema = chat._columns(chat.EXAMPLE)
    back = lambda rows: [x for b in chat._combine(chat._read(iter([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)]))) for x in b.to_pylist()]
    assert [(r["n_turns"], r["n_examples"]) for r in back(good)] == [(4, 2)]
    for bad in (good[1:], [good[0], (1, 2, u, a, start, start + 1)], [good[0], (1, 2, u + u, a, start + len(u), start + len(u) + 1)]):
        with pytest.raises(ValueError, match="does not go on"):
            back(bad)


def test_chat_escape_is_reversible(spark):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("\\<|n\nab"), 12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape(F.col("t"), line=True).alias("l"))
    for r in df.collect():
        assert chat.unescape(r.e) == r.t and chat.unescape(r.l, line=True) == r.t and "<|" not in r.e and "\n" not in r.l


@pytest.mark.parametrize("bounded", [0, 1, 4096])
def test_language_sample_takes_the_first_ids_of_each_language(spark, monkeypatch, bounded):
    """However many rows a language has, and whether or not its ids are bounded before they are dealt."""
    monkeypatch.setattr(language, "BOUNDED", bounded)
    rows = [(i, "t", "en" if i % 10 else ("de" if i % 20 else None)) for i in range(12_000)] + [(i, "u", "en") for i in range(50)] + [(None, "t", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = sorted((r.lang, r.doc_id) for r in language.training_rows(df, 70, 40).select("lang", "doc_id").collect())
    hashed = {r.doc_id: r.h for r in spark.range(12_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).collect()}
    ids = {k: sorted({i for i, _, lang in rows if lang == k and i is not None and zlib.crc32(str(i).encode()) % 5}, key=lambda i: (hashed[i], i))[:40] for k in ("de", "en")}
    ranked = sorted((n, lang, i) for lang, of in ids.items() for n, i in enumerate(of))[:70]
    assert got == sorted((lang, i) for _, lang, i in ranked)
