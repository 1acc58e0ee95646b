"""The decision rules as columns; in every chain the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passwatch.functions.text import SEVERITY, lookup


def alert_level(n: Column, max_conf: Column, in_zone: Column, cloud: Column, history: Column) -> Column:
    """GREEN, YELLOW, ORANGE or RED of a scene. A missing confidence counts as 0."""
    max_conf, in_zone = F.coalesce(max_conf, F.lit(0.0)), F.coalesce(in_zone, F.lit(False))
    clouded = (cloud > 0.4) & (history > 0)
    return (
        F.when((n == 0) & clouded, "YELLOW")
        .when(n == 0, "GREEN")
        .when((n >= 3) | ((max_conf >= 0.85) & in_zone) | (history >= 3), "RED")
        .when((max_conf >= 0.70) | (in_zone & (max_conf >= 0.60)) | clouded, "ORANGE")
        .when(max_conf >= 0.40, "YELLOW")
        .otherwise("GREEN")
    )


def ovv_trigger(conf: Column, kind: Column, zone: Column, history: Column) -> Column:
    """A struct (trigger, reason, priority) of one detection; zone is null outside all zones."""
    conf, kind = F.coalesce(conf, F.lit(0.0)), F.coalesce(kind, F.lit("unknown"))
    inside, seen = zone.isNotNull(), history.cast("string")

    def says(priority: int, *parts) -> Column:
        reason = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        return F.struct(F.lit(priority < 5).alias("trigger"), reason.alias("reason"), F.lit(priority).alias("priority"))

    return (
        F.when((conf >= 0.85) & inside, says(1, "High-confidence ", kind, " in ", zone))
        .when(history >= 3, says(1, "Recurring anomaly — ", seen, " prior observations"))
        .when((conf >= 0.70) & inside, says(2, "Medium-high confidence ", kind, " in ", zone))
        .when(history >= 2, says(2, "Repeated anomaly — ", seen, " prior observations"))
        .when((conf >= 0.80) & kind.isin("airplane", "ship"), says(2, "High confidence ", kind, " requires verification"))
        .when((conf < 0.55) & inside, says(3, "Low-confidence detection in ", zone, " — verify"))
        .otherwise(says(5, "No OVV trigger conditions met"))
    )


def reconcile_alert(policy: Column, advisory: Column) -> Column:
    """The more severe of two alerts; the policy's on a tie."""
    return F.when(lookup(policy, SEVERITY, 0) >= lookup(advisory, SEVERITY, 0), policy).otherwise(advisory)


def risk_tier(conf: Column) -> Column:
    return F.when(F.coalesce(conf, F.lit(0.0)) > 0.6, "MEDIUM").otherwise("LOW")


def detection_quality(conf: Column, strength: Column) -> Column:
    return F.when((conf >= 0.75) & (strength >= 0.3), "high").when((conf >= 0.55) | (strength >= 0.2), "medium").otherwise("low")
