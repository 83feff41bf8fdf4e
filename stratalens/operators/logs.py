"""Container log records: relabelling, selection, volume and listing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.timegrid import floor_to

FIELD_LIMIT = 1000
RANGE = "6 hours"


@dataclass(frozen=True)
class Keep:
    """Drop records whose field does not match the pattern as a whole."""

    source: str
    pattern: str

    def __call__(self, logs: DataFrame) -> DataFrame:
        return logs.where(F.col(self.source).rlike(f"^(?:{self.pattern})$"))


@dataclass(frozen=True)
class Extract:
    """Set a field to a group of a whole match; no match leaves it as it is."""

    source: str
    pattern: str
    target: str
    group: int = 1

    def __call__(self, logs: DataFrame) -> DataFrame:
        whole = f"^(?:{self.pattern})$"
        old: Column = F.col(self.target) if self.target in logs.columns else F.lit(None).cast("string")
        found = F.regexp_extract(self.source, whole, self.group)
        return logs.withColumn(self.target, F.when(F.col(self.source).rlike(whole), found).otherwise(old))


@dataclass(frozen=True)
class Constant:
    """Set a field to the same text in every record."""

    target: str
    value: str

    def __call__(self, logs: DataFrame) -> DataFrame:
        return logs.withColumn(self.target, F.lit(self.value))


def relabel(logs: DataFrame, rules: Sequence[Keep | Extract | Constant]) -> DataFrame:
    """Apply the rules from left to right; each sees what the ones before made."""
    for rule in rules:
        logs = rule(logs)
    return logs


def container_rules(allowed: Sequence[str], job: str, host: str) -> list[Keep | Extract | Constant]:
    """Keep the allowed containers, strip the leading slash, set job and host."""
    return [
        Keep("container_name", "/(" + "|".join(allowed) + ")"),
        Extract("container_name", "^/(.*)$", "container_name"),
        Constant("job", job),
        Constant("host", host),
    ]


def select_logs(logs: DataFrame, stream: dict[str, str], host_re: str = ".+", search: str = "") -> DataFrame:
    """Equality on stream labels, whole match on host, case-blind search in the line."""
    for label, value in stream.items():
        logs = logs.where(F.col(label) == value)
    logs = logs.where(F.col("host").rlike(f"^({host_re})$"))
    return logs.where(F.col("msg").rlike(f"(?i){search}")) if search else logs


def last(df: DataFrame, span: str, now: Column, ts: str = "ts") -> DataFrame:
    """Rows in (now - span, now]."""
    return df.where((F.col(ts) > now - F.expr(f"INTERVAL {span}")) & (F.col(ts) <= now))


def log_volume(logs: DataFrame, step: int) -> DataFrame:
    """Records per container and time bucket of ``step`` seconds."""
    bucket = floor_to(F.unix_seconds("ts"), step)
    return logs.groupBy(bucket.alias("bucket"), "container_name").agg(F.count("*").alias("count"))


def series_total(volume: DataFrame) -> DataFrame:
    return volume.groupBy("container_name").agg(F.sum("count").alias("total"))


def list_logs(logs: DataFrame, limit: int, ties: Sequence[str] = ()) -> DataFrame:
    """Newest records first, copies included."""
    return logs.orderBy(F.col("ts").desc(), *[F.col(t).desc() for t in ties]).limit(limit)


def field_values(logs: DataFrame, field: str, limit: int = FIELD_LIMIT) -> DataFrame:
    return logs.select(field).distinct().orderBy(field).limit(limit)
