"""Texts on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours, icons and notes of the reports.
ALERT_COLORS = {"GREEN": "#22c55e", "YELLOW": "#eab308", "ORANGE": "#f97316", "RED": "#ef4444", "UNKNOWN": "#6b7280"}
CLASS_COLORS = {"ship": "#3b82f6", "airplane": "#f59e0b", "storage-tank": "#8b5cf6", "harbor": "#10b981", "unknown": "#6b7280"}
CONF_COLORS = ((0.8, 1.0, "#d4d4d4"), (0.6, 0.8, "#8b8b8b"), (0.4, 0.6, "#f5f5f5"), (0.0, 0.4, "#f5f5f5"))
ALERT_ICONS = {"RED": "[!]", "ORANGE": "[*]", "YELLOW": "[-]", "GREEN": "[+]"}
ALERT_NOTES = {"RED": " — IMMEDIATE ATTENTION REQUIRED", "ORANGE": " — elevated activity flagged", "YELLOW": " — monitoring recommended"}
SEVERITY = {"GREEN": 0, "YELLOW": 1, "ORANGE": 2, "RED": 3, "UNKNOWN": 0}
TYPE_CODES = {"unknown": 0, "ship": 1, "airplane": 2, "storage-tank": 3, "harbor": 4}


def lookup(column: Column | str, table: dict, default=None) -> Column:
    """table[column], or the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[F.col(column) if isinstance(column, str) else column]
    return found if default is None else F.coalesce(found, F.lit(default))


def percent(x: Column | str) -> Column:
    """A share as a whole percentage."""
    return F.concat(F.round((F.col(x) if isinstance(x, str) else x) * 100).cast("int").cast("string"), F.lit("%"))


def fixed(x: Column | str, digits: int) -> Column:
    """x with so many digits, as printf rounds: by its exact value, so that 0.575, which is held as a little less, becomes 0.57; true ties go to the even digit.

    format_string rounds the shortest decimal form half up. Where that form is a tie, the product with 10**digits is taken in two exact parts.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale, size = 10.0**digits, F.abs(x)
    high = size * 134217729.0 - (size * 134217729.0 - size)  # the upper half of its bits
    low = F.floor(size * scale).cast("double")
    over = (high * scale - (low + 0.5)) + (size - high) * scale
    up = (over > 0) | ((over == 0) & (low % 2 == 1))
    tied = F.signum(x) * F.when(up, low + 1).otherwise(low) / scale
    return F.format_string(f"%.{digits}f", F.when(F.abs(over) < 1e-6, tied).otherwise(x))


def thousands(x: Column | str) -> Column:
    return F.format_number(x, 0)


def conf_color(conf: Column | str) -> Column:
    """The colour of the first range, bounds included, that holds a confidence."""
    conf = F.col(conf) if isinstance(conf, str) else conf
    out = None
    for low, high, color in CONF_COLORS:
        hit = (conf >= low) & (conf <= high)
        out = F.when(hit, color) if out is None else out.when(hit, color)
    return out.otherwise("#8b8b8b")


def display_ts(ts: Column | str, n: int = 19) -> Column:
    return F.replace(F.substring(ts, 1, n), F.lit("T"), F.lit(" "))


def short_band_name(name: Column | str) -> Column:
    """The text in brackets, or the name itself."""
    inner = F.regexp_extract(name, r"\(([^)]*)", 1)
    return F.when(inner == "", F.col(name) if isinstance(name, str) else name).otherwise(inner)
