"""Row enrichment: user agent, geography, sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import agents
from tidegauge.functions.addresses import address_key, network_bits, prefix
from tidegauge.functions.running import prefix_scan


def enrich_user_agent(events: DataFrame) -> DataFrame:
    """Overwrite browser, version and system with what the user agent tells.

    ``device_type`` is only filled where the sender gave none. An empty or
    unrecognised user agent changes nothing.
    """
    agent, given = F.col("user_agent"), F.col("device_type")
    # Columns of their own, so that each text search runs once per row.
    marked = events.withColumn("_bot", agents.crawler(agent))
    marked = marked.withColumns(
        {
            "_family": F.when(F.col("_bot").isNull(), agents.browser_index(agent)),
            "_system": F.when(F.col("_bot").isNull(), agents.system_index(agent)),
        }
    )
    bot, family, system = F.col("_bot"), F.col("_family"), F.col("_system")
    device = F.coalesce(
        F.when(bot.isNotNull(), F.lit(agents.DEVICES["crawler"])),
        agents.device(system),
        F.when(family.isNotNull(), F.lit("unknown")),
        given,
    )
    updated = {
        "browser": F.coalesce(agents.browser(family), F.nullif(bot, F.lit("")), "browser"),
        "browser_version": F.coalesce(agents.browser_version(agent, family), "browser_version"),
        "os": F.coalesce(agents.system(system), "os"),
        "device_type": F.when(given.isin("", "unknown"), device).otherwise(given),
    }
    return marked.select(*[updated[c].alias(c) if c in updated else F.col(c) for c in events.columns])


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 text as a number; anything else is null."""
    valid = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    number = sum(
        F.split_part(ip, F.lit("."), F.lit(i + 1)).try_cast("bigint") * 256 ** (3 - i) for i in range(4)
    )
    return F.when(valid, number)


def enrich_geo(events: DataFrame, ranges: DataFrame, ip: str = "ip", bucket_bits: int = 16) -> DataFrame:
    """Attach country, region, city, lat and lng of the address range an IP falls in.

    ``ranges(start, end, country, region, city, lat, lng)`` must not overlap.
    Both sides are cut into blocks of ``2**bucket_bits`` addresses, so the range
    join becomes an equi-join on the block with a residual test; a range yields
    one row per block it touches. Spark broadcasts the ranges if their measured
    size allows and otherwise shuffles both sides by block.
    """
    block = 2**bucket_bits
    blocks = ranges.select(
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))).alias("_block"),
        F.col("start").alias("_start"),
        F.col("end").alias("_end"),
        *[F.col(c).alias(f"geo_{c}") for c in ("country", "region", "city", "lat", "lng")],
    )
    numbered = events.withColumn("_ip", ipv4_number(F.col(ip))).withColumn("_block", F.floor(F.col("_ip") / block))
    found = numbered.join(
        blocks, (numbered["_block"] == blocks["_block"]) & F.col("_ip").between(F.col("_start"), F.col("_end")), "left"
    )
    return found.drop("_ip", "_block", "_start", "_end")


def longest_prefix(addresses: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """``ip`` and the columns of the most specific of ``networks`` (``network`` and others) that holds it.

    ``addresses`` are made distinct first. Each meets the networks by an equi-join on prefix length and prefix, once for
    every length that occurs, at most 129; the longest wins, ties go to the smallest ``network``. Networks may nest,
    repeat and mix IPv4 with IPv6. Addresses without a network, and text that is none, are left out.
    """
    facts = F.struct("network", *[c for c in networks.columns if c != "network"])
    known = networks.select(network_bits(F.col("network")).alias("_bits"), "network", facts.alias("_facts")).where("_bits IS NOT NULL")
    key = address_key(F.split_part("network", F.lit("/"), F.lit(1)))
    known = known.select("_bits", prefix(key, F.col("_bits")).alias("_prefix"), "_facts")
    lengths = sorted(r["_bits"] for r in known.select("_bits").distinct().collect())
    # A prefix has one answer, however many networks repeat it: an address meets at most one row per length.
    known = known.groupBy("_bits", "_prefix").agg(F.min("_facts").alias("_facts"))
    distinct = addresses.select(F.col(ip).alias("_ip")).distinct().withColumn("_key", address_key(F.col("_ip")))
    tried = distinct.where("_key IS NOT NULL").select("_ip", "_key", F.explode(F.lit(lengths).cast("array<int>")).alias("_bits"))
    met = tried.select("_ip", "_bits", prefix(F.col("_key"), F.col("_bits")).alias("_prefix")).join(known, ["_bits", "_prefix"])
    best = met.groupBy("_ip").agg(F.min(F.struct((-F.col("_bits")).alias("n"), F.col("_facts").alias("f"))).alias("_best"))
    return best.select(F.col("_ip").alias(ip), *[F.col(f"_best.f.`{c}`") for c in networks.columns])


def enrich_geo_networks(events: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Attach ``geo_network, geo_country, geo_region, geo_city, geo_lat, geo_lng`` of the longest prefix that holds an IP.

    ``networks(network, country, region, city, lat, lng)``: IPv4 and IPv6, nested as they like.
    """
    places = longest_prefix(events, networks, ip)
    return events.join(places.select(ip, *[F.col(c).alias(f"geo_{c}") for c in networks.columns]), ip, "left").select(
        *events.columns, *[f"geo_{c}" for c in networks.columns]
    )


def session_sequence(events: DataFrame) -> DataFrame:
    """Number the events of a session from 1 in time order (``sequence_number``); no session is sorted in one task."""
    return prefix_scan(
        events,
        keys=["project_id", "session_id"],
        order=["timestamp", "event_id"],
        values={"sequence_number": F.lit(1)},
        combine="sum",
    )
