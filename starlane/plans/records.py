"""Records as collectors get them: JSON lines of an operation log and of an event stream, parsed with a schema, admitted, projected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.expr import core_host, flag
from starlane.plans import registry as r
from starlane.plans.registry import query
from starlane.sources.bindings import Tables

# Names in the records.
SERVICE = "atproto_pds"
REPLIED, QUOTED = 1 << 20, 1 << 21
LONGEST_LANG, LONGEST_NAME = 20, 253
SCHEME = "at://"

OPERATION = f"""did string, cid string, nullified boolean, createdAt string,
    operation struct<type:string, prev:string, service:string, handle:string, alsoKnownAs:array<string>, services:struct<{SERVICE}:struct<endpoint:string>>>, broken string"""
EVENT = """did string, time_us bigint, kind string,
    commit struct<operation:string, collection:string, rkey:string, record:struct<text:string, langs:array<string>, reply:struct<parent:struct<uri:string>>, embed:struct<`$type`:string>, subject:string>>, broken string"""


def parsed(lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """lines with its JSON as columns; what does not parse, or has no did, has broken set (a scan counts it and goes on)."""
    record = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.withColumn("__r", record).select(*lines.columns, "__r.*")
    return rows.withColumn("broken", F.when(F.col("did").isNull() | F.col("broken").isNotNull(), F.col(column)))


def normal_endpoint(url: Column) -> Column:
    """One trailing slash off, lower case, https: as operations are compared."""
    return F.regexp_replace(F.lower(F.regexp_replace(url, "/$", "")), "^http://", "https://")


def without_slashes(url: Column) -> Column:
    """All trailing slashes off, https, case kept: as scans name hosts."""
    return F.regexp_replace(F.rtrim(url, F.lit("/")), "^http://", "https://")


def without_slash(url: Column) -> Column:
    """One trailing slash off, nothing else: as charts show it."""
    return F.regexp_replace(url, "/$", "")


def endpoint(operation: Column) -> Column:
    """A host from either shape of an operation: the old one has it at the top, the other under services."""
    return F.when(operation["type"] == "create", operation["service"]).otherwise(operation["services"][SERVICE]["endpoint"])


def named(raw: Column) -> Column:
    """A name without white space around it, in lower case, cut at LONGEST_NAME characters; null if nothing is left."""
    return F.nullif(F.substring(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), 1, LONGEST_NAME), F.lit(""))


def first_name(aliases: Column, old: Column) -> Column:
    """The first alias of the names' scheme that is a name, else what the old field says."""
    found = F.filter(F.transform(F.filter(aliases, lambda x: x.startswith(SCHEME)), lambda x: named(F.substr(x, F.lit(len(SCHEME) + 1)))), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, 0), named(old))


def handle(operation: Column) -> Column:
    return first_name(operation["alsoKnownAs"], operation["handle"])


def sql_named(raw: str) -> str:
    return f"nullif(substr(lower(regexp_replace({raw}, '^\\s+|\\s+$', '', 'g')), 1, {LONGEST_NAME}), '')"


def sql_first_name(aliases: str, old: str) -> str:
    """SQL of first_name."""
    return f"coalesce(list_filter(list_transform(list_filter({aliases}, lambda x: starts_with(x, '{SCHEME}')), lambda x: {sql_named(f'substr(x, {len(SCHEME) + 1})')}), lambda x: x IS NOT NULL)[1], {sql_named(old)})"


def uri_did(uri: Column) -> Column:
    """The account of a record's address, or null."""
    return F.nullif(F.regexp_extract(uri, "^at://(did:[^/]+)", 1), F.lit(""))


def address(did: Column, collection: Column, key: Column) -> Column:
    return F.concat(F.lit("at://"), did, F.lit("/"), collection, F.lit("/"), key)


def operations(t: Tables) -> DataFrame:
    return parsed(t.op_lines, OPERATION)


def events(t: Tables) -> DataFrame:
    return parsed(t.event_lines, EVENT).withColumn("ts", F.timestamp_micros("time_us"))


_OP = f"""(SELECT seq, json_extract_string(line, '$.did') AS did, json_extract_string(line, '$.operation.type') AS kind, CAST(json_extract_string(line, '$.nullified') AS BOOLEAN) AS nullified, CAST(json_extract_string(line, '$.createdAt') AS DATE) AS day,
    CASE WHEN json_extract_string(line, '$.operation.type') = 'create' THEN json_extract_string(line, '$.operation.service') ELSE json_extract_string(line, '$.operation.services.{SERVICE}.endpoint') END AS endpoint,
    {sql_first_name("json_extract_string(line, '$.operation.alsoKnownAs[*]')", "json_extract_string(line, '$.operation.handle')")} AS handle FROM {{op_lines}} WHERE json_valid(line))"""
_EV = """(SELECT seq, json_extract_string(line, '$.did') AS did, json_extract_string(line, '$.kind') AS kind, json_extract_string(line, '$.commit.operation') AS operation, json_extract_string(line, '$.commit.collection') AS collection, json_extract_string(line, '$.commit.rkey') AS rkey,
    json_extract(line, '$.commit.record') AS record, CAST(make_timestamp(CAST(json_extract_string(line, '$.time_us') AS BIGINT)) AS DATE) AS day FROM {event_lines} WHERE json_valid(line))"""
_NORMAL = "regexp_replace(lower(regexp_replace(endpoint, '/$', '')), '^http://', 'https://')"


@query("src03_operations", f"SELECT did, seq, kind, nullified, day, {_NORMAL} AS host, handle FROM {_OP}")
def parsed_operations(t: Tables) -> DataFrame:
    """The log's lines as rows: endpoint from either shape, normalised, and handle; lines that do not parse are left out."""
    op = F.col("operation")
    rows = operations(t).where("broken is null")
    return rows.select("did", "seq", op["type"].alias("kind"), "nullified", F.to_date(F.substring("createdAt", 1, 10)).alias("day"), normal_endpoint(endpoint(op)).alias("host"), handle(op).alias("handle"))


@query("flt31_endpoint_moves", f"WITH o AS (SELECT *, {_NORMAL} AS host FROM {_OP} WHERE NOT nullified), s AS (SELECT did, seq, host, lag(host) OVER (PARTITION BY did ORDER BY day, seq) AS before FROM o WHERE host IS NOT NULL) SELECT did, seq, before AS from_host, host AS to_host FROM s WHERE before <> host")
def endpoint_moves(t: Tables) -> DataFrame:
    """Moves from the records themselves: an operation without a host (a tombstone) is none."""
    op = F.col("operation")
    rows = operations(t).where("broken is null AND NOT nullified").select("did", "seq", F.col("createdAt").alias("at"), normal_endpoint(endpoint(op)).alias("host")).where("host is not null")
    before = F.lag("host").over(Window.partitionBy("did").orderBy("at", "seq"))
    return rows.withColumn("from_host", before).where("from_host <> host").select("did", "seq", "from_host", F.col("host").alias("to_host"))


@query(
    "flt21_url_forms",
    "WITH o AS (SELECT DISTINCT endpoint FROM " + _OP + " WHERE endpoint IS NOT NULL) SELECT endpoint, rtrim(endpoint, '/') AS stripped, " + _NORMAL + " AS compared, regexp_replace(rtrim(endpoint, '/'), '^http://', 'https://') AS scanned, regexp_replace(endpoint, '/$', '') AS shown FROM o",
)
def url_forms(t: Tables) -> DataFrame:
    """The four ways in which a host's address is made comparable."""
    rows = operations(t).where("broken is null").select(endpoint(F.col("operation")).alias("endpoint")).where("endpoint is not null").distinct()
    e = F.col("endpoint")
    return rows.select("endpoint", F.rtrim(e, F.lit("/")).alias("stripped"), normal_endpoint(e).alias("compared"), without_slashes(e).alias("scanned"), without_slash(e).alias("shown"))


@query("sm15_malformed", f"SELECT 'operations' AS source, count(*) AS lines, {r.long_sum('NOT json_valid(line)')} AS dropped FROM {{op_lines}} UNION ALL SELECT 'events', count(*), {r.long_sum('NOT json_valid(line)')} FROM {{event_lines}}")
def malformed(t: Tables) -> DataFrame:
    """Lines that do not parse are dropped, and counted."""
    tally = lambda df, name: df.agg(F.count("*").alias("lines"), F.sum(flag(F.col("broken").isNotNull())).alias("dropped")).select(F.lit(name).alias("source"), "lines", "dropped")
    return tally(operations(t), "operations").unionByName(tally(events(t), "events"))


_BITS = f"(CASE WHEN json_extract(record, '$.reply') IS NOT NULL THEN {REPLIED} ELSE 0 END) | (CASE WHEN json_extract_string(record, '$.embed.\"$type\"') IN ('record', 'recordWithMedia') THEN {QUOTED} ELSE 0 END) | 1"


@query("flt28_reply_quote_bits", f"SELECT did, day, CAST(bit_or({_BITS}) AS INTEGER) AS mask, count(*) AS posts FROM {_EV} WHERE operation = 'create' AND collection = 'post' GROUP BY 1, 2")
def reply_quote_bits(t: Tables) -> DataFrame:
    """Each account's bits of each day, with those of replies and quotes from inside the record."""
    record = F.col("commit")["record"]
    quoted = F.coalesce(record["embed"]["$type"].isin("record", "recordWithMedia"), F.lit(False))
    bits = F.when(record["reply"].isNotNull(), REPLIED).otherwise(0).bitwiseOR(F.when(quoted, QUOTED).otherwise(0)).bitwiseOR(F.lit(1))
    posts = events(t).where("broken is null AND commit.operation = 'create' AND commit.collection = 'post'")
    return posts.groupBy("did", F.to_date("ts").alias("day")).agg(F.bit_or(bits).alias("mask"), F.count("*").alias("posts"))


@query(
    "flt35_langs_admitted",
    f"""WITH p AS (SELECT did, day, json_extract_string(record, '$.langs[*]') AS langs FROM {_EV} WHERE operation = 'create' AND collection = 'post'),
    l AS (SELECT did, unnest(langs) AS lang FROM p) SELECT lang, count(*) AS n, count(DISTINCT did) AS accounts FROM l WHERE length(lang) <= {LONGEST_LANG} GROUP BY 1""",
)
def langs_admitted(t: Tables) -> DataFrame:
    """Tags of posts: each of a list that is not empty, if it is a string of twenty characters or less."""
    posts = events(t).where("broken is null AND commit.operation = 'create' AND commit.collection = 'post'")
    tags = posts.select("did", F.explode(F.filter("commit.record.langs", lambda x: F.length(x) <= LONGEST_LANG)).alias("lang"))
    return tags.groupBy("lang", "did").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("accounts"))


def targets(t: Tables) -> DataFrame:
    """did, target, collection: a follow's subject is an account, a like's or a repost's a record, a reply's the record before it; posts that are no replies act on no one."""
    kind, record = F.col("commit")["collection"], F.col("commit")["record"]
    subject = record["subject"]
    target = F.when(kind == "follow", subject).when(kind.isin("like", "repost"), uri_did(F.get_json_object(subject, "$.uri"))).when(kind == "post", uri_did(record["reply"]["parent"]["uri"]))
    return events(t).where("broken is null AND commit.operation = 'create'").select("did", target.alias("target"), kind.alias("collection")).where("target like 'did:%'")


_TARGET = """CASE WHEN collection = 'follow' THEN json_extract_string(record, '$.subject') WHEN collection IN ('like', 'repost') THEN regexp_extract(json_extract_string(record, '$.subject.uri'), '^at://(did:[^/]+)', 1)
    WHEN collection = 'post' THEN regexp_extract(json_extract_string(record, '$.reply.parent.uri'), '^at://(did:[^/]+)', 1) END"""


@query("flt29_interactions", f"WITH x AS (SELECT did, collection, {_TARGET} AS target FROM {_EV} WHERE operation = 'create') SELECT did, target, collection, count(*) AS n FROM x WHERE target LIKE 'did:%' AND target <> did GROUP BY 1, 2, 3")
def interactions(t: Tables) -> DataFrame:
    """Who acts on whom, but for those who act on themselves."""
    return targets(t).where("target <> did").groupBy("did", "target", "collection").agg(F.count("*").alias("n"))


@query("jn23_cross_host_interactions", f"WITH x AS (SELECT did, {_TARGET} AS target FROM {_EV} WHERE operation = 'create'), y AS (SELECT a.host AS from_host, b.host AS to_host FROM x LEFT JOIN {{accounts}} a ON x.did = concat('did:', a.did) LEFT JOIN {{accounts}} b ON x.target = concat('did:', b.did) WHERE target LIKE 'did:%') SELECT coalesce(from_host, '?') AS from_host, coalesce(to_host, '?') AS to_host, count(*) AS n, from_host IS NULL OR to_host IS NULL AS unresolved FROM y GROUP BY 1, 2, 4")
def cross_host_interactions(t: Tables) -> DataFrame:
    """Both ends of each interaction by their hosts; those with an end that is not known are counted apart."""
    unresolved = F.col("from_host").isNull() | F.col("to_host").isNull()
    return between_hosts(t).groupBy("from_host", "to_host").agg(F.sum("n").alias("n"), F.first(unresolved).alias("unresolved")).select(F.coalesce("from_host", F.lit("?")).alias("from_host"), F.coalesce("to_host", F.lit("?")).alias("to_host"), "n", "unresolved")


def between_hosts(t: Tables) -> DataFrame:
    """from_host, to_host (null where an end is not known), collection, n. Interactions are counted by their ends before hosts are looked up, and by one known host before the other is: what everyone acts on is one row for each host."""
    pairs = targets(t).groupBy("did", "target", "collection").agg(F.count("*").alias("n"))
    host = t.accounts.select(F.concat(F.lit("did:"), F.col("did").cast("string")).alias("id"), "host")
    one = pairs.join(host.select(F.col("id").alias("did"), F.col("host").alias("from_host")), "did", "left").groupBy("from_host", "target", "collection").agg(F.sum("n").alias("n"))
    both = one.join(host.select(F.col("id").alias("target"), F.col("host").alias("to_host")), "target", "left")
    return both.groupBy("from_host", "to_host", "collection").agg(F.sum("n").alias("n"))


_ENDS = f"(SELECT x.collection, a.host AS f, b.host AS g, coalesce(a.host LIKE '%.core.network', false) AS fc, coalesce(b.host LIKE '%.core.network', false) AS gc FROM (SELECT did, collection, {_TARGET} AS target FROM {_EV} WHERE operation = 'create') x LEFT JOIN {{accounts}} a ON x.did = concat('did:', a.did) LEFT JOIN {{accounts}} b ON x.target = concat('did:', b.did) WHERE target LIKE 'did:%')"


@query(
    "ag33_interactions_by_type",
    f"""WITH e AS {_ENDS} SELECT 'type' AS part, collection AS name, count(*) AS total, {r.long_sum('f <> g')} AS crossing, {r.long_sum('f = g')} AS same FROM e GROUP BY 2
    UNION ALL SELECT 'federation', CASE WHEN f = g THEN 'same host' WHEN fc AND gc THEN 'core to core' WHEN fc THEN 'core to indie' WHEN gc THEN 'indie to core' ELSE 'indie to indie' END, count(*), {r.long_sum('f <> g')}, {r.long_sum('f = g')} FROM e WHERE f IS NOT NULL AND g IS NOT NULL GROUP BY 2""",
)
def interactions_by_type(t: Tables) -> DataFrame:
    """Each kind of interaction in all, between hosts and inside one; and those with both ends known by whose hosts they join. From counts by pairs of hosts."""
    rows, (f, g) = between_hosts(t), (F.col("from_host"), F.col("to_host"))
    sums = lambda df, part: df.groupBy("name").agg(F.sum("n").alias("total"), F.sum(F.when(f != g, F.col("n")).otherwise(0)).alias("crossing"), F.sum(F.when(f == g, F.col("n")).otherwise(0)).alias("same")).select(F.lit(part).alias("part"), "name", "total", "crossing", "same")
    a, b = core_host(f), core_host(g)
    kind = F.when(f == g, "same host").when(a & b, "core to core").when(a, "core to indie").when(b, "indie to core").otherwise("indie to indie")
    return sums(rows.withColumnRenamed("collection", "name"), "type").unionByName(sums(rows.where(f.isNotNull() & g.isNotNull()).withColumn("name", kind), "federation"))


@query("sm05_latest_records", f"WITH x AS (SELECT did, rkey, seq, operation, json_extract_string(record, '$.text') AS text FROM {_EV} WHERE collection = 'post') SELECT did, rkey, arg_max(operation, seq) AS operation, arg_max(coalesce(text, ''), seq) AS text, max(seq) AS seq FROM x GROUP BY 1, 2 HAVING arg_max(operation, seq) <> 'delete'")
def latest_records(t: Tables) -> DataFrame:
    """What stands under each key after all of the log: the last one written, unless it was deleted since."""
    posts = events(t).where("broken is null AND commit.collection = 'post'")
    last = posts.groupBy("did", F.col("commit.rkey").alias("rkey")).agg(F.max(F.struct("seq", "commit.operation", F.coalesce("commit.record.text", F.lit("")).alias("text"))).alias("l"))
    return last.select("did", "rkey", "l.operation", "l.text", "l.seq").where("operation <> 'delete'")


@query("sm06_distinct_edges", f"SELECT did AS liker, target, min(seq) AS first_seq FROM (SELECT did, seq, {_TARGET} AS target FROM {_EV} WHERE operation = 'create' AND collection = 'like') WHERE target LIKE 'did:%' GROUP BY 1, 2")
def distinct_edges(t: Tables) -> DataFrame:
    """An edge counts once however often the stream says it; replays change nothing."""
    likes = events(t).where("broken is null AND commit.operation = 'create' AND commit.collection = 'like'")
    rows = likes.select(F.col("did").alias("liker"), uri_did(F.get_json_object("commit.record.subject", "$.uri")).alias("target"), "seq").where("target is not null")
    return rows.groupBy("liker", "target").agg(F.min("seq").alias("first_seq"))
