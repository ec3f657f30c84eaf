"""One query for each operator, over the whole of its table, and the SQL that it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.llm import chat, decontaminate, language, licenses, linededup, mixing, near, negatives, quality, ranked, sharding, toxicity, warc
from starlane.llm.common import finished, spread, table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spread(table(spark, sf_dir, "documents")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(spread(table(spark, sf_dir, "documents")), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spread(table(spark, sf_dir, "documents")), share=1.5, cap=2.0, weights=(5, 2, 1), keep_columns=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, spread(table(spark, sf_dir, "pages")), least=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spread(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(spread(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    back = chat.read_back(chat.layout(turns.unionByName(probe)))
    return back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.dedup(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spread(table(spark, sf_dir, "embeddings")), label=label)


def _finished(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result as a table of its own, so that none of its other scratch tables stay."""
    return lambda spark, sf_dir: finished(lambda: query(spark, sf_dir), query.__name__)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    one_pass = {f.__name__: f for f in (op6_license_scan, op7_language)}
    return {f.__name__: _finished(f) for f in (op1_shard, op2_ngram_jaccard, op3_decontaminate, op4_mix_sources, op5_warc, op8_toxicity, op9_quality_rules, op10_chat_format, op11_line_dedup, op12_ranked_search, op13_hard_negatives)} | one_pass


_OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
spot AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, spot.k AS k, item FROM spot JOIN win ON spot.s = win.s AND spot.k = win.k),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
q AS (SELECT *, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), '-'), CAST(size AS VARCHAR))) AS o FROM d),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY k) AS r FROM q GROUP BY k),
w AS (SELECT k, source_size, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS full_before,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS open,
             row_number() OVER (ORDER BY cap / weight, k) AS rank FROM w),
f AS (SELECT arg_min((total - full_before) / open, rank) AS level FROM l WHERE (total - full_before) / open <= cap / weight),
t AS (SELECT k, source_size, least(cap, coalesce(weight * level, cap)) AS target FROM l LEFT JOIN f ON true),
p AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY k ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM q JOIN t USING (k)),
e AS (SELECT size, place / target AS fin FROM p WHERE size > 0 UNION ALL SELECT size, (1.0::DOUBLE * source_size + place) / target FROM p WHERE size > 0),
c AS (SELECT max(fin) AS cut FROM (SELECT fin, sum(size) OVER (ORDER BY fin RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e) WHERE upto <= (SELECT sum(size) * 1.5::DOUBLE FROM d))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (CAST(place / target <= cut AS INTEGER) + CAST((1.0::DOUBLE * source_size + place) / target <= cut AS INTEGER)) END AS BIGINT) AS taken
FROM p, c
"""

_OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1) GROUP BY r),
ln AS (SELECT r, host, text, x, length(x) AS chars, regexp_replace(lower(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[\x20\x09-\x0D]+', ' ', 'g') AS line FROM (SELECT r, host, text, unnest(l) AS x FROM w)),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
bad AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM ln GROUP BY host, line) JOIN hosts USING (host) WHERE n > 20 AND n > least(1000.0::DOUBLE, 0.10::DOUBLE * texts)),
gone AS (SELECT r, sum(chars) AS chars FROM ln JOIN bad USING (host, line) GROUP BY r),
every AS (SELECT r, sum(chars) AS chars FROM ln GROUP BY r),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.chars, 0) AS gone, coalesce(every.chars, 0) AS every
      FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r) LEFT JOIN every USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND every - gone >= 0.30::DOUBLE * every AS kept
FROM o
"""


_OP5 = r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head,
             list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: CAST('0x' || substr(h, i, 5) AS INTEGER)) AS v FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM g
"""

_OP10 = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x,
             24 + length(replace(replace(replace(coalesce(role, ''), '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT r, doc_id, i, x[i] AS line, translate(trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d)),
often AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS BIGINT) >= 5),
j AS (SELECT r, l.doc_id, i, line, often.k IS NOT NULL AND l.doc_id IS DISTINCT FROM keeper AS gone FROM l LEFT JOIN often ON l.k = often.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""


_OP12 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT row_number() OVER () AS r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
a AS (SELECT DISTINCT q, unnest(w) AS t FROM b),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM h) WHERE t IN (SELECT t FROM a) GROUP BY r, t),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM h),
f AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, docs),
i AS (SELECT p.r, h.doc_id, p.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS points FROM p JOIN h ON p.r = h.r JOIN f ON p.t = f.t, s),
g AS (SELECT q, r, doc_id, CAST(sum(points) AS BIGINT) AS score FROM a JOIN i ON a.t = i.t GROUP BY q, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0) JOIN b USING (q) WHERE rank <= 10
"""

_OP13 = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
q AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM q JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _OP3, "op4_mix_sources": _OP4, "op5_warc": _OP5, "op9_quality_rules": _OP9, "op10_chat_format": _OP10, "op11_line_dedup": _OP11, "op12_ranked_search": _OP12, "op13_hard_negatives": _OP13}
