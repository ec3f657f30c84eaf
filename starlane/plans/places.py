"""Languages and namespaces on the map: what accounts use, joined by their hosts to the places of those hosts; and the hosts' directory as it is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.functions.expr import bare, core_host, namespace
from starlane.operators.archetypes import allocate
from starlane.plans.hosts import _LATEST, PLACE, _placed, latest
from starlane.plans.registry import query
from starlane.sources.bindings import Tables
from starlane.sources.scratch import shared_folder

#: The name under which all of the platform's own hosts count, and the root of its own collections.
CORE, OWN = "core.network", "core.app"
#: Hosts in one file of the directory.
PAGE = 1000

_CDN = "(org LIKE '%Cloudflare%' OR org LIKE '%Fastly%')"
_GEO = f"(SELECT host, CASE WHEN coalesce({_CDN}, false) THEN '{PLACE['city']}' ELSE city END AS city, CASE WHEN coalesce({_CDN}, false) THEN NULL ELSE country END AS country FROM {_LATEST})"


def geo(t: Tables) -> DataFrame:
    """Hosts with a place that can be named."""
    return latest(t).select("host", _placed("city"), _placed("country")).where("city is not null")


def core_cities(t: Tables) -> DataFrame:
    """The platform's cities, each by the first of its hosts there: a city counts once however many hosts it has."""
    return geo(t).where(core_host(F.col("host"))).groupBy("city").agg(F.min(F.struct("host", "country")).alias("h")).select(F.lit(CORE).alias("group"), "h.host", "city", "h.country")


def lang_rows(t: Tables) -> DataFrame:
    """Speakers by host and base language, the platform's hosts as one."""
    group = F.when(core_host(F.col("host")), F.lit(CORE)).otherwise(bare(F.col("host")))
    rows = t.did_langs.where("lang <> ''").join(t.homes, "did").select(group.alias("group"), F.substring_index("lang", "-", 1).alias("lang"), "did")
    return rows.distinct().groupBy("group", "lang").agg(F.count("*").alias("dids"))


@query(
    "q69_lang_locations",
    f"""WITH g AS (SELECT * FROM {_GEO} WHERE city IS NOT NULL), c AS (SELECT city, min(host) AS host, arg_min(country, host) AS country, row_number() OVER (ORDER BY city) AS i, count(*) OVER () AS k FROM g WHERE host LIKE '%.core.network' GROUP BY 1),
    l AS (SELECT CASE WHEN rtrim(host, '/') LIKE '%.core.network' THEN '{CORE}' ELSE rtrim(host, '/') END AS grp, split_part(lang, '-', 1) AS lang, count(DISTINCT l.did) AS dids FROM {{did_langs}} l JOIN {{homes}} h ON l.did = h.did WHERE lang <> '' GROUP BY 1, 2)
    SELECT g.host, city, country, lang, dids FROM l JOIN g ON l.grp = g.host UNION ALL SELECT c.host, city, country, lang, dids // k + CASE WHEN i <= dids % k THEN 1 ELSE 0 END FROM l, c WHERE grp = '{CORE}'""",
)
def lang_locations(t: Tables) -> DataFrame:
    """Speakers of each language by place. Those on the platform's own hosts are spread evenly over its cities, remainders by name, so that no speaker is lost or doubled; hosts without a place are not on the map."""
    rows, columns = lang_rows(t), ["host", "city", "country", "lang", "dids"]
    own = allocate(rows.where(F.col("group") == CORE), core_cities(t), "group", ["lang"], "dids", "city").select(*columns)
    return rows.withColumnRenamed("group", "host").join(geo(t), "host").select(*columns).unionByName(own)


_NS = f"(SELECT collection, rtrim(host, '/') AS host, count(DISTINCT k.did) AS dids FROM {{collections}} k JOIN {{homes}} h ON k.did = h.did WHERE collection NOT LIKE '{OWN}.%' GROUP BY 1, 2)"


@query("q69b_namespace_locations", f"SELECT split_part(collection, '.', 1) || '.' || split_part(collection, '.', 2) AS ns, collection, g.host, city, country, dids FROM {_NS} k JOIN {_GEO} g ON k.host = g.host WHERE city IS NOT NULL")
def namespace_locations(t: Tables) -> DataFrame:
    """Users of each third-party collection by the places of their hosts."""
    rows = t.collections.where(~F.col("collection").startswith(f"{OWN}.")).join(t.homes, "did").select("collection", bare(F.col("host")).alias("host"), "did").distinct()
    by = rows.groupBy("collection", "host").agg(F.count("*").alias("dids"))
    return by.join(geo(t), "host").select(namespace(F.col("collection")).alias("ns"), "collection", "host", "city", "country", "dids")


@query("q69c_top_namespaces", f"SELECT split_part(collection, '.', 1) || '.' || split_part(collection, '.', 2) AS ns, CAST(sum(dids) AS BIGINT) AS total_dids FROM {_NS} k JOIN {_GEO} g ON k.host = g.host WHERE city IS NOT NULL GROUP BY 1 ORDER BY total_dids DESC, ns")
def top_namespaces(t: Tables) -> DataFrame:
    """Namespaces by the users that the map shows, the largest first."""
    return namespace_locations(t).groupBy("ns").agg(F.sum("dids").alias("total_dids")).orderBy(F.desc("total_dids"), "ns")


DIRECTORY = "hosts map<string,struct<version:string,inviteCodeRequired:boolean,status:string>>"


def directory(documents: DataFrame) -> DataFrame:
    """Rows of a directory that is one object of objects for each file: the name is the key, and what an entry lacks has its default (no version, no invite code, offline)."""
    entries = documents.select(F.explode(F.map_entries(F.from_json("value", DIRECTORY)["hosts"])).alias("e"))
    info = F.col("e.value")
    return entries.select(F.col("e.key").alias("url"), info["version"].alias("version"), F.coalesce(info["inviteCodeRequired"], F.lit(False)).alias("invite_required"), F.coalesce(info["status"] == "online", F.lit(False)).alias("is_online"))


@query("src05_directory", "SELECT url, version, coalesce(invite_required = 1, false) AS invite_required, is_online = 1 AND s_online AS is_online FROM (SELECT url, version, invite_required, is_online, total % 7 <> 3 AS s_online, row_number() OVER (PARTITION BY url ORDER BY snap DESC) AS i FROM {snapshots}) WHERE i = 1")
def read_directory(t: Tables) -> DataFrame:
    """The last scan of every host, written as the directory is published and read back; about a thousand hosts to a file, each with only the fields that it has, some without a status."""
    path = f"{shared_folder(t.spark)}/directory"
    last = t.snapshots.groupBy("url").agg(F.max(F.struct("snap", "version", "invite_required", "is_online", "total")).alias("s")).select("url", "s.*")
    # Fields that are null are left out of the JSON.
    info = F.struct("version", (F.col("invite_required") == 1).alias("inviteCodeRequired"), F.when(F.col("total") % 7 != 3, F.when(F.col("is_online") == 1, "online").otherwise("offline")).alias("status"))
    pages = -(-last.count() // PAGE) or 1
    numbered = last.select(F.pmod(F.xxhash64("url"), F.lit(pages)).alias("page"), F.struct("url", info.alias("info")).alias("entry"))
    files = numbered.groupBy("page").agg(F.map_from_entries(F.collect_list("entry")).alias("hosts"))
    files.select(F.to_json(F.struct("hosts")).alias("value")).write.text(path)
    return directory(t.spark.read.text(path))
