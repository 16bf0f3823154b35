"""Dimension tables and request headers, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from workload.adapters import AS_OF, base_events, pick, table

TIER_NAMES = list(S.TIERS)


def _project() -> Column:
    return F.concat(F.lit("proj-"), F.col("c_custkey")).alias("project_id")


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("proj-"), key).alias("id"),
        F.col("c_name").alias("name"),
        pick(TIER_NAMES, key).alias("tier"),
        (key % 10 != 9).alias("active"),
        F.when(key % 4 == 0, F.lit(1)).alias("rate_limit"),
    )


def _raw_key(number: Column) -> Column:
    return F.concat(F.lit("owk_live_"), F.md5(F.concat(F.lit("key-"), number)))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.sha2(_raw_key(key), 256).alias("key_hash"),
        F.concat(F.lit("proj-"), key).alias("tenant_id"),
        F.col("c_name").alias("name"),
        (key % 12 != 11).alias("active"),
        F.when(key % 5 == 0, F.dateadd(F.to_date(F.lit(AS_OF)), (key % 3 - 1).cast("int")).cast("timestamp")).alias(
            "expires_at"
        ),
        F.when(key % 8 == 7, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("write"))).alias(
            "permissions"
        ),
    )


def features(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Feature flags per project; of all customers, or without some, whose projects are then unknown."""
    key = F.col("c_custkey")
    flags = [
        F.when(key % 4 != 3, (key + i) % 3 != 0).alias(flag) for i, flag in enumerate(S.FEATURE_TYPES)
    ]
    known = F.lit(True) if every else key % 9 != 6
    return table(spark, sf_dir, "customer").filter(known).select(_project(), *flags)


def mau_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _project(), (F.col("c_custkey") % 5 * 4 + 10).cast("int").alias("limit")
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention policy per project; some override a setting of their tier."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _project(),
        pick(TIER_NAMES, key).alias("tier"),
        F.when(key % 4 == 1, F.lit(240)).alias("raw_retention_hours"),
        F.when(key % 6 == 1, F.lit(100)).alias("aggregate_retention_hours"),
        F.when(key % 6 == 3, F.lit(48)).alias("compression_after_hours"),
    )


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    start = (key % 32) * 16777216 + F.floor(key / 32) * 524288
    return table(spark, sf_dir, "supplier").select(
        start.cast("bigint").alias("start"),
        (start + 524187).cast("bigint").alias("end"),
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("country"),
        F.when(key % 2 == 0, F.col("s_name")).alias("region"),
        F.lit(None).cast("string").alias("city"),
        (key % 180 - 90).cast("double").alias("lat"),
        F.col("s_acctbal").alias("lng"),
    )


def ip_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of both families, nested: two IPv4 and two IPv6 lengths."""
    key, number = F.col("s_suppkey"), lambda c: F.lower(F.hex(c))
    four, six = (key % 32).cast("string"), F.concat(F.lit("2001:db8:"), number(key % 64))
    networks = F.array(
        F.concat(four, F.lit(".0.0.0/8")),
        F.when(key % 3 == 0, F.concat(four, F.lit("."), key % 100, F.lit(".0.0/16"))),
        F.concat(six, F.lit("::/48")),
        F.when(key % 2 == 0, F.concat(six, F.lit(":"), number(key % 100), F.lit("::/64"))),
    )
    place = {"country": F.concat(F.lit("N"), F.col("s_nationkey")), "region": F.lit(None), "city": F.lit(None)}
    return table(spark, sf_dir, "supplier").select(
        F.explode(F.array_compact(networks)).alias("network"),
        *[c.cast("string").alias(n) for n, c in place.items()],
        *[F.lit(None).cast("double").alias(n) for n in ("lat", "lng")],
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request header row per source event, in eleven variants."""
    eid, uid = F.col("eid"), F.col("uid")
    variant = eid % 11
    good = _raw_key(uid % 40)
    digest = F.md5(F.concat(F.lit("key-"), uid % 40))

    def bearer(key: Column) -> Column:
        return F.concat(F.lit("Bearer "), key)

    authorization = (
        F.when(variant == 1, bearer(F.concat(F.lit("key_"), digest)))
        .when(variant == 2, F.lit("Basic abc"))
        .when(variant == 5, bearer(F.concat(F.lit("owk_prod_"), digest)))
        .when(variant == 6, bearer(F.concat(F.lit("owk_live_"), F.substring(digest, 1, 31), F.lit("!"))))
        .when(variant == 7, F.lit("Bearer "))
        .when(variant == 8, bearer(F.concat(F.lit("  "), good, F.lit(" "))))
        .when(variant == 9, bearer(F.concat(F.lit("owk_test_"), F.md5(F.concat(F.lit("none-"), eid)))))
        .when(variant.isin(4, 10), bearer(good))
    )
    ip = F.concat_ws(".", uid % 32, F.col("k"), F.col("cents") % 256, eid % 256)
    return base_events(spark, sf_dir).select(
        eid.alias("request_id"),
        authorization.alias("authorization"),
        F.when(variant.isin(2, 3), good).when(variant == 4, F.lit("garbage")).alias("x_api_key"),
        F.when(eid % 3 == 0, F.concat(ip, F.lit(" , 10.0.0.1"))).when(eid % 3 == 1, ip).alias("x_forwarded_for"),
        F.when(eid % 4 != 0, F.concat(F.lit("192.168.0."), F.col("k"))).alias("x_real_ip"),
        ip.alias("ip"),
    )


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.concat(F.lit("/data/"), key).alias("path"),
        F.floor((F.col("s_acctbal") + 1000) * 90000000).cast("bigint").alias("free_space"),
        F.when(key % 17 == 0, F.lit(0)).otherwise(F.lit(1000000000000)).cast("bigint").alias("total_space"),
    )


