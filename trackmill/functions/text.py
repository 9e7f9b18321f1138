"""Parsing and formatting of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: accepted time stamps, the first that fits counts
TIMES = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]


def parse_time(c: Column) -> Column:
    """A wall-clock time, or null. A trailing Z or offset is read and dropped: times are UTC."""
    c = F.regexp_replace(F.trim(c), r"(Z|[+-]\d\d:?\d\d)$", "")
    # offsets need a time before them, else a date's own day would be cut
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in TIMES])


def pad_time(c: Column) -> Column:
    """HHmmss whose leading zeros are missing."""
    return F.when(F.length(c) <= 6, F.lpad(c, 6, "0")).otherwise(c)


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1000, F.format_string("%.1f米", metres)).otherwise(F.format_string("%.2f公里", metres / 1000))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d小时%d分钟", h, m)).when(m > 0, F.format_string("%d分钟%d秒", m, s % 60)).otherwise(F.format_string("%d秒", s))


def rate_text(matched: Column, total: Column) -> Column:
    """Share in percent with one decimal; nothing of nothing is 0%."""
    return F.when((matched > 0) & (total > 0), F.format_string("%.1f%%", matched * 100.0 / total)).otherwise(F.lit("0%"))


def figure_text(value: Column, unit: str) -> Column:
    """Two decimals and a unit, or N/A where there is nothing to tell."""
    return F.when(value != 0, F.format_string(f"%.2f {unit}", value)).otherwise(F.lit("N/A"))


def coordinate_text(c: Column) -> Column:
    return F.format_string("%.6f", c)


def size_text(n: Column) -> Column:
    """Bytes with a binary unit."""
    units = ["Bytes", "KB", "MB", "GB", "TB"]
    out = F.concat(F.round(n / float(1024**4), 2).cast("string"), F.lit(" TB"))
    for k in range(3, -1, -1):
        out = F.when(n < 1024 ** (k + 1), F.concat(F.round(n / float(1024**k), 2).cast("string"), F.lit(f" {units[k]}"))).otherwise(out)
    return F.when(n == 0, F.lit("0 Bytes")).otherwise(out)


def extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def stem(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def unique_name(name: Column, mark: Column) -> Column:
    """The name with a mark (a time and a random text, say) before its extension."""
    return F.concat(stem(name), F.lit("_"), mark, F.lit("."), extension(name))


#: fixed values: source kinds in the order in which a first line is tested, and their categories
CATEGORY = {"taxi_gps": "continuous_trajectory", "bus_gps": "continuous_trajectory", "gpx": "continuous_trajectory", "csv": "continuous_trajectory", "bus_card": "transaction", "metro_card": "transaction", "taxi_transaction": "transaction"}


def detect_format(line: Column) -> Column:
    """What kind of file a first line begins."""
    n = F.size(F.split(line, ","))
    return (
        F.when(F.ltrim(line).startswith("<?xml"), "gpx")
        .when(n == 10, "taxi_gps")
        .when(line.contains(" ") & line.contains("T"), "bus_card")
        .when(line.contains(",") & (line.contains("21") | line.contains("22")), "metro_card")
        .when(n > 15, "bus_gps")
        .when(n == 11, "taxi_transaction")
        .otherwise("csv")
    )


def category(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    return F.coalesce(F.element_at(table, kind), F.lit("continuous_trajectory"))
