"""Text, bytes, JSON, map, time and status functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status numbers and names, job states, and their report texts.
STATUS = {0: "INITIAL", 1: "RUNNING", 2: "PENDING", 3: "SUCCEED", 4: "FAILED"}
TRAIN_STATUS = {"INITIAL": 0, "RUNNING": 1, "NEARTHEEND": 3, "SUCCEED": 3, "FAILED": 4}
JOB_TEXT = {"finished": "FINISH", "pending": "PENDING", "not exists": "N/A", "running": "RUNNING", "killed": "KILLED"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def status_name(code: Column) -> Column:
    return F.try_element_at(literal_map(STATUS), code)


def status_code(name: Column) -> Column:
    return F.try_element_at(literal_map({n: c for c, n in STATUS.items()}), name)


def train_status_code(name: Column) -> Column:
    return F.try_element_at(literal_map(TRAIN_STATUS), name)


def job_text(state: Column) -> Column:
    return F.try_element_at(literal_map(JOB_TEXT), state)


def host(endpoint: Column) -> Column:
    return F.split_part(endpoint, F.lit(":"), F.lit(1))


def port(endpoint: Column) -> Column:
    return F.regexp_extract(endpoint, r":(\d+)$", 1).try_cast("int")


def bounds(text: Column) -> Column:
    """``min:max`` as a struct; one number stands for both."""
    low = F.split_part(text, F.lit(":"), F.lit(1)).try_cast("int")
    high = F.split_part(text, F.lit(":"), F.lit(-1)).try_cast("int")
    return F.struct(low.alias("low"), high.alias("high"))


def strip_prefix(key: Column, prefix: Column) -> Column:
    return F.when(F.startswith(key, prefix), F.substr(key, F.length(prefix) + 1)).otherwise(key)


def service_path(root: Column, service: Column, server: Column) -> Column:
    return F.concat(F.lit("/"), F.concat_ws("/", root, service, F.lit("nodes"), server))


def bytes_text(value: Column) -> Column:
    """UTF-8 bytes as text; null stays null."""
    return F.decode(value, "utf-8")


def cpu_quantity(text: Column) -> Column:
    """CPU request: ``250m`` is 0.25, absent is 0."""
    milli = F.regexp_extract(text, r"^(\d+)m$", 1).try_cast("double") * 0.001
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(F.endswith(text, F.lit("m")), milli).otherwise(text.try_cast("double"))


def day_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def epoch_seconds(ts: Column) -> Column:
    return F.floor(epoch_micros(ts) / 1_000_000)


def epoch_millis(ts: Column) -> Column:
    return F.floor(epoch_micros(ts) / 1_000)
