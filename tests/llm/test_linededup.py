"""Line dedup against a plain version, on odd rows, with one hot line and with texts of very many lines."""

from collections import Counter, defaultdict

import pytest

from starlane.llm import linededup

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_chars=40, least_documents=5):
    key = lambda line: line.strip(BLANK).translate(LOW)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc_id)
    keeper = {k: max(v, key=lambda x: (x is not None, x)) for k, v in holders.items() if len(v) >= least_documents}
    out = Counter()
    for doc_id, text in rows:
        all_ = (text or "").split("\n")
        left = [x for x in all_ if key(x) not in keeper or keeper[key(x)] == doc_id]
        out[doc_id, "\n".join(left), len(all_), len(all_) - len(left)] += 1
    return out


def got(df, **how):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.dedup(df, **how).collect())


LINE = "Subscribe to our weekly letter — é and get more"
ROWS = [(i, f"own {i}\n  {LINE if i % 2 else LINE.upper().replace('É', 'é')}\t\n\nend") for i in range(5)] + [
    (9, LINE), (9, LINE), (None, LINE), (None, f"{LINE}\n{LINE}\nx"), (10, None), (11, ""), (12, "\n\n"), (None, None), (13, "y" * 40), (14, "y" * 40 + "\r"), (15, "short"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "a", 7) for r in ROWS], "doc_id long, text string, n_lines string, gone int").repartition(3)
    assert got(df) == plain(ROWS)
    assert linededup.dedup(df).columns == ["doc_id", "text", "gone", "n_lines", "n_dropped"]
    assert got(df, least_chars=1, least_documents=2) == plain(ROWS, 1, 2)
    assert linededup.dedup(df.limit(0)).count() == 0


def test_a_key_in_four_documents_stays_and_repeated_rows_are_one(spark):
    rows = [(i, LINE) for i in (1, 2, 3, 4)] * 3
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    rows.append((None, LINE))
    assert sum(n for (i, t, _, gone), n in got(spark.createDataFrame(rows, "doc_id long, text string")).items() if gone) == 10


@pytest.mark.parametrize("parts", [1, 1000])
def test_against_a_plain_version(spark, sf_dir, monkeypatch, parts):
    """With all keys met by shuffle (none has more than all of the pairs), and with the usual share."""
    monkeypatch.setattr(linededup, "HOT_PARTS", parts)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs, least_documents=2) == plain([(r.doc_id, r.text) for r in docs.collect()], least_documents=2)


def test_a_line_in_all_documents_and_a_text_of_very_many_lines(spark):
    rows = [(i, f"{LINE}\nnumber {i}") for i in range(3000)] + [(5000, "\n".join([LINE] * 20000 + [f"{i:050d}" for i in range(20000)]))]
    rows += [(5001 + i, "\n".join(f"{i:050d}" for i in range(20000))) for i in range(5)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
