"""Text forms of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """Binary units with two decimals, whole bytes below a kibibyte."""
    unit = lambda size, name: F.format_string(f"%.2f {name}", n.cast("double") / float(size))
    return F.when(n >= 1 << 30, unit(1 << 30, "GB")).when(n >= 1 << 20, unit(1 << 20, "MB")).when(n >= 1 << 10, unit(1 << 10, "KB")).otherwise(F.format_string("%d B", n))


def si_bytes(n: Column) -> Column:
    """Decimal units with two significant digits below ten."""
    steps = [(10**12, "TB"), (10**9, "GB"), (10**6, "MB"), (10**3, "kB")]
    out = F.format_string("%d B", n)
    for size, name in reversed(steps):
        v = n.cast("double") / float(size)
        out = F.when(n >= size, F.when(v < 10, F.format_string(f"%.1f {name}", v)).otherwise(F.format_string(f"%.0f {name}", v))).otherwise(out)
    return out


def rfc3339(ts: Column) -> Column:
    """Second precision, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_rfc3339(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssXXX")
