"""The logical tables of the library, bound to the given tables.

Each is one SELECT that Spark and other SQL engines read alike; {name} stands for a given table or another binding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from starlane.sources.tables import table

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

BINDINGS = {
    # One row for each account and day; bits: 1 post, 2 like, 4 repost, 8 follow, 16 other.
    "activity": """SELECT user_id AS did, CAST(ts AS DATE) AS dt,
        CAST(bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 ELSE 16 END) AS INT) AS mask
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "accounts": """SELECT c_custkey AS did,
        CASE WHEN c_custkey % 3 = 0 THEN DATE '2022-11-01' + CAST(c_custkey * 37 % 420 AS INT) ELSE DATE '2024-01-01' + CAST(c_custkey % 23 AS INT) END AS created,
        concat('https://', lower(replace(n_name, '_', '-')), CASE WHEN n_regionkey = 0 THEN '.core.network' ELSE '.host.net' END) AS host
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "account_labels": """SELECT doc_id AS did, CASE WHEN toxic = 1 THEN 'spam' WHEN quality = 0 THEN 'impersonation' ELSE 'benign' END AS label,
        DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS labeled FROM {labels}""",
    "repo_status": """SELECT c_custkey AS did, CASE WHEN c_custkey % 3 = 0 THEN 'deactivated' WHEN c_custkey % 3 = 1 THEN 'takendown' ELSE 'deleted' END AS status
        FROM {customer} WHERE c_acctbal < 0""",
    "excluded": """SELECT did FROM {repo_status} UNION SELECT did FROM {account_labels} WHERE label = 'spam'""",
    "cohort": """SELECT a.did, a.created, a.host, CASE WHEN a.host LIKE '%.core.network' THEN 'core' ELSE 'indie' END AS host_type
        FROM {accounts} a LEFT JOIN {excluded} x ON a.did = x.did WHERE x.did IS NULL""",
    "account_events": """SELECT CAST(ts AS DATE) AS dt, CASE event_type WHEN 'click' THEN 'account:deleted' WHEN 'view' THEN 'account:deactivated'
        WHEN 'purchase' THEN 'account:reactivated' WHEN 'signup' THEN 'account:takendown' ELSE 'other' END AS event_type, count(*) AS n
        FROM {events} GROUP BY CAST(ts AS DATE), event_type""",
    "oplog": """SELECT o_custkey AS did, o_orderkey AS op_id, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderstatus = 'P' AS nullified,
        concat('https://', lower(replace(replace(o_orderpriority, ' ', '-'), '-not-specified', '-none')), CASE WHEN o_orderpriority < '2' THEN '.core.network' ELSE '.host.net' END) AS host,
        concat('user', CAST(o_custkey AS VARCHAR(20)), '-', CAST(o_orderkey % 7 AS VARCHAR(20))) AS handle FROM {orders}""",
    "ops": """SELECT did, op_id, ts, host, lag(host) OVER (PARTITION BY did ORDER BY ts, op_id) AS before,
        row_number() OVER (PARTITION BY did ORDER BY ts, op_id) AS nth FROM {oplog} WHERE NOT nullified""",
    "creations": """SELECT did, host, ts FROM {ops} WHERE nth = 1""",
    "migrations": """SELECT did, op_id, before AS from_host, host AS to_host, ts FROM {ops} WHERE nth > 1 AND before <> host""",
    "current_host": """SELECT o.did, o.host FROM {ops} o JOIN (SELECT did, max(nth) AS nth FROM {ops} GROUP BY did) m ON o.did = m.did AND o.nth = m.nth""",
    # One row for each host and month, with what a scan of it would report; some hosts are not public ones.
    "snapshots": """SELECT concat('https://', lower(replace(s_name, '#', '-')), CASE WHEN s_suppkey % 10 = 0 THEN '.core.network' WHEN s_suppkey % 29 = 3 THEN '.local' WHEN s_suppkey % 29 = 7 THEN '.test:8080' ELSE '.host.net' END, CASE WHEN s_suppkey % 7 = 0 AND m % 5 = 0 THEN '/' ELSE '' END) AS url,
        m AS snap, total, active, CAST(CASE WHEN s_suppkey % 9 = 4 THEN 0 ELSE 1 END AS INT) AS is_online,
        CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 2 AS INT) END AS invite_required,
        CASE WHEN (s_suppkey + m) % 3 = 0 THEN NULL ELSE concat('0.4.', CAST(m % 13 AS VARCHAR(20))) END AS version,
        CASE WHEN (s_suppkey + m) % 4 = 1 THEN NULL ELSE n_name END AS country, CASE WHEN (s_suppkey + m) % 4 = 1 THEN NULL ELSE concat('C', CAST(n_nationkey AS VARCHAR(20))) END AS country_code,
        CASE WHEN (s_suppkey + m) % 4 = 1 THEN NULL ELSE concat('city', CAST(s_suppkey % 12 AS VARCHAR(20))) END AS city,
        CASE WHEN (s_suppkey + m) % 4 = 1 THEN NULL ELSE CAST(n_nationkey * 2 AS DOUBLE) END AS lat, CASE WHEN (s_suppkey + m) % 4 = 1 THEN NULL ELSE CAST(s_suppkey % 12 * 5 AS DOUBLE) END AS lon,
        CASE WHEN (s_suppkey + m) % 4 = 1 THEN NULL WHEN s_suppkey % 8 = 0 THEN 'Cloudflare, Inc.' WHEN s_suppkey % 8 = 1 THEN 'Hetzner Online GmbH' WHEN s_suppkey % 8 = 2 THEN 'DigitalOcean, LLC'
             WHEN s_suppkey % 8 = 3 THEN 'Amazon.com' WHEN s_suppkey % 8 = 4 THEN '' WHEN s_suppkey % 8 = 5 THEN 'Fastly, Inc.' ELSE concat('Org ', CAST(s_suppkey % 5 AS VARCHAR(20))) END AS org,
        CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE concat('10.1.0.', CAST(s_suppkey % 40 AS VARCHAR(20))) END AS ip, CAST(s_suppkey % 3 AS INT) AS in_directory, CAST(CASE WHEN (s_suppkey * 3 + m) % 17 = 0 THEN 1 ELSE 0 END AS INT) AS is_partial
        FROM (SELECT l_suppkey, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS m, count(*) AS total, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS active FROM {lineitem} GROUP BY 1, 2) l
        JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    # Where accounts live, by the names that scans have.
    "homes": """SELECT c_custkey AS did, concat('https://', lower(replace(s_name, '#', '-')), CASE WHEN s_suppkey % 10 = 0 THEN '.core.network' WHEN s_suppkey % 29 = 3 THEN '.local' WHEN s_suppkey % 29 = 7 THEN '.test:8080' ELSE '.host.net' END) AS host
        FROM {customer} CROSS JOIN (SELECT count(*) AS hosts FROM {supplier}) h JOIN {supplier} ON s_suppkey = c_custkey % hosts""",
    # Lines as a log of operations has them: an old and a new shape, tombstones, a line in 53 cut off, aliases that are no names, blank or too long.
    "op_lines": """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 53 = 7 THEN concat('{"did":"did:', CAST(o_custkey AS VARCHAR(20)), '","cid":') ELSE
        concat('{"did":"did:', CAST(o_custkey AS VARCHAR(20)), '","cid":"c', CAST(o_orderkey AS VARCHAR(20)), '","nullified":', CASE WHEN o_orderstatus = 'P' THEN 'true' ELSE 'false' END, ',"createdAt":"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), 'T00:00:00.000Z","operation":{',
        CASE o_orderkey % 5 WHEN 0 THEN concat('"type":"create","prev":null,"service":"http://Host-', CAST(CAST(floor(o_custkey / 40.0) AS BIGINT) AS VARCHAR(20)), '.example.net/","handle":"user', CAST(o_custkey AS VARCHAR(20)), '.net"')
        WHEN 1 THEN '"type":"tombstone","prev":"c0"'
        ELSE concat('"type":"operation","prev":"c0","alsoKnownAs":', CASE o_orderkey % 11 WHEN 2 THEN concat('["dns:x","at:// User', CAST(o_custkey AS VARCHAR(20)), '.Net "]') WHEN 4 THEN concat('["at://  ","at://', repeat('x', 250), CAST(o_custkey AS VARCHAR(20)), '"]') WHEN 6 THEN concat('["none"],"handle":" Old', CAST(o_custkey AS VARCHAR(20)), '.net"') WHEN 8 THEN '[]'
            ELSE concat('["at://user', CAST(o_custkey AS VARCHAR(20)), '-', CAST(o_orderkey % 3 AS VARCHAR(20)), '.net"]') END, ',"services":{"atproto_pds":{"endpoint":"https://host-', CAST(CAST(floor(o_custkey / 60.0) AS BIGINT) + o_orderkey % 3 AS VARCHAR(20)), CASE WHEN o_orderkey % 7 = 0 THEN '.example.net//' ELSE '.Example.net' END, '"}}') END, '}}') END AS line
        FROM {orders}""",
    # Lines as a stream of events has them; subjects are accounts or records, by the kind of record. Accounts and keys of records grow with the table; some subjects are no account that is known.
    "event_lines": """SELECT event_id AS seq, CASE WHEN event_id % 61 = 9 THEN '{"did":' ELSE
        concat('{"did":"did:', CAST(user_id AS VARCHAR(20)), '","time_us":', CAST(CAST(floor(value * 1000.0) AS BIGINT) * 40000000 + 1704067200000000 AS VARCHAR(20)), ',"kind":"commit","commit":{"operation":"', CASE WHEN event_id % 11 = 3 THEN 'delete' WHEN event_id % 11 = 5 THEN 'update' ELSE 'create' END, '","collection":"',
        CASE event_type WHEN 'click' THEN 'post' WHEN 'view' THEN 'like' WHEN 'purchase' THEN 'repost' WHEN 'signup' THEN 'follow' ELSE 'block' END, '","rkey":"k', CAST(CAST(floor(event_id / 200.0) AS BIGINT) AS VARCHAR(20)), '"',
        CASE WHEN event_id % 11 = 3 THEN '' ELSE concat(',"record":{"text":"t', CAST(event_id AS VARCHAR(20)), '"',
            CASE event_id % 4 WHEN 0 THEN ',"langs":["en","de-CH"]' WHEN 1 THEN ',"langs":[]' WHEN 2 THEN ',"langs":["a-tag-that-is-far-too-long"]' ELSE '' END,
            CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN concat(',"reply":{"parent":{"uri":"at://did:', CAST(user_id + CAST(floor(event_id / 500.0) AS BIGINT) AS VARCHAR(20)), '/post/k', CAST(CAST(floor(event_id / 200.0) AS BIGINT) AS VARCHAR(20)), '"}}') ELSE '' END,
            CASE WHEN event_id % 6 = 1 THEN ',"embed":{"$type":"record"}' WHEN event_id % 6 = 2 THEN ',"embed":{"$type":"images"}' ELSE '' END,
            CASE WHEN event_type = 'signup' THEN concat(',"subject":"did:', CAST((user_id + CAST(floor(event_id / 500.0) AS BIGINT)) * 7 AS VARCHAR(20)), '"') WHEN event_type IN ('view', 'purchase') THEN concat(',"subject":{"uri":"at://did:', CAST((user_id + CAST(floor(event_id / 500.0) AS BIGINT)) * 13 AS VARCHAR(20)), '/post/k2"}') ELSE '' END, '}') END, '}}') END AS line
        FROM {events}""",
    "did_langs": """SELECT CAST(floor(doc_id / 5.0) AS BIGINT) AS did, concat(lang, CASE WHEN doc_id % 4 = 0 THEN '-x' ELSE '' END) AS lang, count(*) AS posts FROM {documents} WHERE lang IS NOT NULL GROUP BY 1, 2""",
    "collections": """SELECT concat(CASE WHEN page_id % 5 = 0 THEN 'core.app' ELSE concat('ns', CAST(page_id % 6 AS VARCHAR(20)), '.', CASE WHEN page_id % 2 = 0 THEN 'blog' ELSE 'chat' END) END, '.item', CAST(page_id % 3 AS VARCHAR(20))) AS collection,
        CAST(floor(page_id / 2.0) AS BIGINT) AS did, DATE '2024-01-01' + CAST(page_id % 30 AS INT) AS dt, count(*) AS n FROM {pages} GROUP BY 1, 2, 3""",
    "pack_joins": """SELECT concat('pack/', CAST(CAST(floor(user_id / 3.0) AS BIGINT) AS VARCHAR(20))) AS uri, CAST(ts AS DATE) AS dt, count(*) AS n FROM {events} WHERE event_type = 'signup' GROUP BY 1, 2""",
    "follows": """SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
        WHERE a.l_returnflag = 'R' AND a.l_quantity >= 45 AND b.l_returnflag = 'R' AND b.l_quantity >= 45""",
    "vectors": """SELECT vec_id AS node, label AS cluster, embedding FROM {embeddings}""",
    "node_labels": """SELECT doc_id AS node, toxic = 1 AS bad, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS first_labeled FROM {labels}""",
}


def needs(text: str) -> list[str]:
    """The tables that a text names, those of its bindings first."""
    out: list[str] = []
    for name in re.findall(r"\{(\w+)\}", text):
        for n in ([*needs(BINDINGS[name]), name] if name in BINDINGS else []):
            if n not in out:
                out.append(n)
    return out


def as_sql(text: str) -> str:
    """A text over {tables} as one plain SELECT, the bindings it needs as common table expressions."""
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    ctes = [f"{n} AS ({plain(BINDINGS[n])})" for n in needs(text)]
    body = plain(text).strip()
    if not ctes:
        return body
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{word}{', '.join(ctes)}, {body.removeprefix(word)}"
    return f"WITH {', '.join(ctes)} {body}"


class Tables:
    """tables.activity, tables.orders, ...: given tables and bindings as DataFrames, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*BINDINGS, *GIVEN):
            raise AttributeError(name)
        if name not in self._known:
            if name in BINDINGS:
                text = BINDINGS[name].replace("VARCHAR(20)", "STRING")
                # Other braces are text (JSON).
                safe = re.sub(r"\{\{(\w+)\}\}", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
                self._known[name] = self.spark.sql(safe, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})
            else:
                self._known[name] = table(self.spark, self.sf_dir, name)
        return self._known[name]
