"""Feature flags per project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S


def flag_for(event_type: Column) -> Column:
    """Name of the flag that gates an event type; null if it is always on."""
    gates = [(types, flag) for flag, types in S.FEATURE_TYPES.items() if types]
    first_types, first_flag = gates[0]
    return reduce(
        lambda case, gate: case.when(event_type.isin(gate[0]), F.lit(gate[1])),
        gates[1:],
        F.when(event_type.isin(first_types), F.lit(first_flag)),
    )


def with_defaults(features: DataFrame) -> DataFrame:
    """Absent flags take their default: on, except those off by default."""
    return features.select(
        "project_id",
        *[
            F.coalesce(F.col(flag), F.lit(flag not in S.FEATURE_DEFAULT_OFF)).alias(flag)
            for flag in S.FEATURE_TYPES
        ],
    )


def triggers_enabled(features: DataFrame) -> DataFrame:
    """Whether any trigger feature of a project is on."""
    any_flag = reduce(lambda a, b: a | b, [F.col(f) for f in S.TRIGGER_FEATURES])
    return with_defaults(features).select("project_id", any_flag.alias("triggers_enabled"))


def feature_gate(events: DataFrame, features: DataFrame) -> DataFrame:
    """Add ``known_project`` and ``enabled``. Unknown projects get the defaults."""
    flags = with_defaults(features).select(
        "project_id",
        F.create_map(*[c for flag in S.FEATURE_TYPES for c in (F.lit(flag), F.col(flag))]).alias("_flags"),
    )
    flag = flag_for(F.col("event_type"))
    default = ~F.coalesce(flag.isin(S.FEATURE_DEFAULT_OFF), F.lit(False))
    joined = events.withColumn("_flag", flag).join(flags, "project_id", "left")
    enabled = F.when(F.col("_flag").isNull(), F.lit(True)).otherwise(
        F.coalesce(F.try_element_at("_flags", F.col("_flag")), default)
    )
    return joined.select(*events.columns, F.col("_flags").isNotNull().alias("known_project"), enabled.alias("enabled"))


def enabled_events(events: DataFrame, features: DataFrame) -> DataFrame:
    return feature_gate(events, features).filter("enabled").select(*events.columns)


def unknown_projects(events: DataFrame, features: DataFrame) -> DataFrame:
    """Events whose project has no feature record."""
    return events.join(features.select("project_id"), "project_id", "left_anti").select(*events.columns)
