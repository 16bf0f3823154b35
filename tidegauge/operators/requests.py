"""Request headers: API key, client address, and the project a key belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S


def _stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def api_key(authorization: Column, x_api_key: Column) -> Column:
    """The presented key: a Bearer token wins, otherwise ``X-API-Key``."""
    bearer = F.when(authorization.startswith("Bearer "), F.substr(authorization, F.lit(8)))
    return _stripped(F.coalesce(bearer, x_api_key))


def classify_api_keys(requests: DataFrame) -> DataFrame:
    """Add ``api_key``, ``key_code`` (null when well-formed) and ``key_env`` (live/test)."""
    key = F.col("api_key")
    presented = requests.withColumn("api_key", api_key(F.col("authorization"), F.col("x_api_key")))
    well_formed = key.rlike(S.API_KEY_PATTERN)
    return presented.withColumns(
        {
            "key_code": F.when(F.coalesce(key, F.lit("")) == "", "AUTH_001").when(~well_formed, "AUTH_002"),
            "key_env": F.when(well_formed, F.regexp_extract(key, S.API_KEY_PATTERN, 1)),
        }
    )


def client_ip(x_forwarded_for: Column, x_real_ip: Column) -> Column:
    """First hop of ``X-Forwarded-For``, else ``X-Real-IP``, else null."""
    return F.coalesce(_stripped(F.split_part(x_forwarded_for, F.lit(","), F.lit(1))), x_real_ip)


def resolve_projects(requests: DataFrame, keys: DataFrame, tenants: DataFrame, as_of: Column) -> DataFrame:
    """Find each request's project and its ``code`` (null when it may write).

    ``keys(key_hash, tenant_id, active, expires_at, permissions)`` hold SHA-256
    hashes. Plain equi-joins: Spark broadcasts a dimension only if its measured
    size allows, and splits hot keys of the fact side when it shuffles.
    """
    known = keys.select(
        F.col("key_hash"),
        F.col("tenant_id").alias("_tenant"),
        (F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))).alias("_live"),
        F.array_contains("permissions", "write").alias("_may_write"),
    ).join(
        tenants.select(F.col("id").alias("_tenant"), F.col("active").alias("_tenant_active")), "_tenant", "left"
    )
    classified = classify_api_keys(requests).withColumn("key_hash", F.sha2("api_key", 256))
    code = (
        F.when(F.col("key_code").isNotNull(), F.col("key_code"))
        .when(F.col("_tenant").isNull(), "AUTH_003")
        .when(~F.col("_live") | ~F.coalesce("_tenant_active", F.lit(False)), "AUTH_004")
        .when(~F.coalesce("_may_write", F.lit(False)), "AUTH_005")
    )
    joined = classified.join(known, "key_hash", "left").withColumn("code", code)
    return joined.select(
        *requests.columns,
        "key_env",
        F.when(F.col("code").isNull(), F.col("_tenant")).alias("project_id"),
        "code",
    )
