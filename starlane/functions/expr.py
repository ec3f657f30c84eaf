"""Column builders that queries share: buckets, bits, weeks, host names, rounding."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the daily activity mask.
POST, LIKE, REPOST, FOLLOW = 1, 2, 4, 8
BITS = {"posted": POST, "liked": LIKE, "reposted": REPOST, "followed": FOLLOW}

# Cohorts by creation date, the label of each and the day before which it ends.
AGE_BUCKETS = (("1. pre-2023", "2023-01-01"), ("2. 2023", "2024-01-01"), ("3. 2024 pre-Nov", "2024-11-01"), ("4. 2024 Nov-Dec (exodus)", "2025-01-01"), ("5. 2025 H1", "2025-07-01"), ("6. 2025 H2", "2026-01-01"))
LAST_BUCKET = "7. 2026"
NEW_BUCKET, NEW_DAYS = "0. new accounts", 14

# Patterns of host URLs that are not public hosts.
JUNK = (
    "%localhost%", "%127.0.0.1%", "%0.0.0.0%", "%192.168.%", "%10.0.%", "%172.16.%", "%ngrok%", "%.surge.sh%", "%.uwu%", "%uwu.%",
    "%.test", "%.test/%", "%.test:%", "%//example.%", "%.example", "%.example/%", "%.example:%", "%.invalid", "%.invalid/%", "%.local", "%.local/%", "%.local:%",
    "%.internal", "%.internal/%", "%.internal:%", "%.lan", "%.lan/%", "%.lan:%", "%.home", "%.home/%", "%.home:%", "%//core.network%",
)
MOST_URL = 200

# Hosting providers by parts of the organisation's name; the first that fits.
PROVIDERS = (
    ("Behind Cloudflare (host unknown)", ("Cloudflare",)), ("DigitalOcean", ("DigitalOcean", "Digital Ocean")), ("Hetzner", ("Hetzner", "HETZNER")), ("OVH", ("OVH",)), ("AWS", ("AWS", "Amazon")),
    ("Google Cloud", ("Google",)), ("Azure", ("Microsoft", "Azure")), ("Akamai/Linode", ("Linode", "Akamai")), ("Vultr", ("Vultr",)), ("i3D.net", ("i3Dnet", "i3D.net")), ("Scaleway", ("Scaleway",)),
    ("Oracle Cloud", ("Oracle",)), ("Contabo", ("Contabo",)), ("Fastly (CDN)", ("Fastly",)), ("Fly.io", ("Fly.io", "Fly IO")), ("netcup", ("netcup", "NETCUP")), ("RackNerd", ("RackNerd",)), ("IONOS", ("IONOS", "Ionos")),
)
CDN = ("Cloudflare", "Fastly")

# User-count classes, the label of each and its largest count.
SIZES = (("0", 0), ("1", 1), ("2-5", 5), ("6-10", 10), ("11-50", 50), ("51-100", 100), ("101-500", 500), ("501-1K", 1000))
LAST_SIZE = "1K+"


def has(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def flag(condition: Column) -> Column:
    """1 or 0 as a long, 0 for null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def round_to(x: Column, digits: int) -> Column:
    """Half up in binary, so that every engine that has floor() agrees."""
    return F.floor(x * F.lit(float(10**digits)) + F.lit(0.5)).cast("double") / F.lit(float(10**digits))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_to(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def spread(x: Column) -> Column:
    """Population standard deviation from the mean of squares, as reports have it."""
    return F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0)))


def age_bucket(created: Column, as_of: Column) -> Column:
    out = F.when(created >= F.date_sub(as_of, NEW_DAYS), F.lit(NEW_BUCKET))
    for label, end in AGE_BUCKETS:
        out = out.when(created < F.lit(end).cast("date"), F.lit(label))
    return out.otherwise(F.lit(LAST_BUCKET))


def size_bucket(n: Column) -> Column:
    out = F.when(n <= SIZES[0][1], F.lit(SIZES[0][0]))
    for label, most in SIZES[1:]:
        out = out.when(n <= most, F.lit(label))
    return out.otherwise(F.lit(LAST_SIZE))


def week(day: Column) -> Column:
    """The Monday of the day's week."""
    return F.date_trunc("week", day).cast("date")


def week_before(day: Column) -> Column:
    """Compatible variant: the Monday on or before the day before, so that a Monday belongs to the week that it ends."""
    return F.date_sub(F.next_day(F.date_sub(day, 1), "MON"), 7)


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def bare(url: Column) -> Column:
    """Without trailing slashes."""
    return F.rtrim(url, F.lit("/"))


def hostname(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


def _as_regex(like: str) -> str:
    return ("" if like.startswith("%") else "^") + re.escape(like.strip("%")) + ("" if like.endswith("%") else r"\z")


def public_host(url: Column) -> Column:
    """Not a private, reserved or throw-away name, with a scheme and a dot, of bounded length. One pattern, so that a url that is an expression is not computed for each of them."""
    return ~url.rlike("|".join(map(_as_regex, JUNK))) & url.rlike(r"(?s)^https?://.*\.") & (F.length(url) <= MOST_URL)


def core_host(url: Column, suffix: str = ".core.network") -> Column:
    """Run by the platform itself."""
    return bare(url).endswith(suffix)


def provider(org: Column) -> Column:
    out = F.when(org.isNull() | (org == ""), F.lit("Unknown"))
    for name, parts in PROVIDERS:
        out = out.when(reduce(lambda a, b: a | b, (org.contains(p) for p in parts)), F.lit(name))
    return out.otherwise(org)


def behind_cdn(org: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (org.contains(p) for p in CDN)), F.lit(False))


def namespace(collection: Column) -> Column:
    """The first two labels of a dotted name."""
    return F.substring_index(collection, ".", 2)


def uniform(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from a hash of the key; the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
