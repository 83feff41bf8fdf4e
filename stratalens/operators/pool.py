"""Score documents: strict parsing, newest entries, poll outcome and gauges.

A document is small and one row, so everything within it is done on arrays in
that row; only putting the two documents of a poll together needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.binary import bound

SCHEMA = (
    "monitors array<struct<id:variant,name:variant>>,"
    "history array<struct<ts:variant,score:variant,offset:variant,rtt:variant,monitor_id:variant>>,"
    "_bad string"
)
KINDS = ("monitors", "overall")
GAUGES = {
    "score": "ntppool_monitor_score",
    "offset_s": "ntppool_monitor_offset_seconds",
    "rtt_s": "ntppool_monitor_rtt_seconds",
}
SCORE_METRIC = "ntppool_score"
SUCCESS_METRIC = "ntppool_scrape_success"


def _kind(leaf: Column) -> Column:
    """'none', 'text', 'whole', 'number' or 'other' for a JSON leaf."""
    name = F.schema_of_variant(leaf)
    return (
        F.when(leaf.isNull() | (name == "VOID"), "none")
        .when(name == "STRING", "text")
        .when(name == "BIGINT", "whole")
        .when(name.startswith("DECIMAL") | (name == "DOUBLE"), "number")
        .otherwise("other")
    )


def _number(leaf: Column) -> Column:
    return F.try_variant_get(leaf, "$", "double")


def _well_typed(doc: Column) -> Column:
    history = F.coalesce(doc["history"], F.array())
    monitors = F.coalesce(doc["monitors"], F.array())
    numeric = ["none", "whole", "number"]
    entry_ok = lambda e: (
        _kind(e["ts"]).isin("none", "text", "whole", "number")
        & _kind(e["score"]).isin(numeric)
        & _kind(e["offset"]).isin(numeric)
        & _kind(e["rtt"]).isin(numeric)
        & _kind(e["monitor_id"]).isin("none", "whole")
    )
    monitor_ok = lambda m: _kind(m["id"]).isin("none", "whole") & _kind(m["name"]).isin("none", "text")
    null_as = lambda test: (lambda e: e.isNull() | test(e))
    return F.forall(history, null_as(entry_ok)) & F.forall(monitors, null_as(monitor_ok))


def parse_docs(docs: DataFrame) -> DataFrame:
    """Add ``ok``, typed ``monitors`` and typed ``history``; arrays are empty if not ok.

    Bad JSON and a field of the wrong type both fail the document. A missing or
    null array is empty. History keeps its order in ``pos``.
    """
    doc = F.from_json(F.col("body"), F.lit(SCHEMA), {"columnNameOfCorruptRecord": "_bad"})
    is_object = F.col("body").rlike(r"(?s)^\s*(\{.*\}|null)\s*$")
    parsed = docs.withColumn("_doc", doc)
    ok = is_object & F.col("_doc._bad").isNull() & _well_typed(F.col("_doc"))
    parsed = parsed.withColumn("ok", F.coalesce(ok, F.lit(False)))
    whole = lambda leaf: F.try_variant_get(leaf, "$", "bigint")
    history = F.transform(
        F.coalesce(F.col("_doc.history"), F.array()),
        lambda e, i: F.struct(
            i.alias("pos"),
            F.when(_kind(e["ts"]) == "text", 1).when(_kind(e["ts"]) == "none", 0).otherwise(2).alias("ts_rank"),
            F.when(_kind(e["ts"]).isin("whole", "number"), _number(e["ts"])).alias("ts_num"),
            F.when(_kind(e["ts"]) == "text", F.try_variant_get(e["ts"], "$", "string")).alias("ts_text"),
            _number(e["score"]).alias("score"),
            _number(e["offset"]).alias("offset"),
            _number(e["rtt"]).alias("rtt"),
            whole(e["monitor_id"]).alias("monitor_id"),
        ),
    )
    monitors = F.transform(
        F.coalesce(F.col("_doc.monitors"), F.array()),
        lambda m: F.struct(
            whole(m["id"]).alias("id"), F.try_variant_get(m["name"], "$", "string").alias("name")
        ),
    )
    typed = parsed.withColumn("history", F.when(F.col("ok"), history)).withColumn(
        "monitors", F.when(F.col("ok"), monitors)
    )
    empty = lambda name: F.coalesce(F.col(name), F.slice(F.col(name), 1, 0), F.array())
    return typed.withColumn("history", empty("history")).withColumn("monitors", empty("monitors")).drop("_doc")


def ts_sort_key(entry: Column) -> Column:
    """Orders mixed times: unset, then text, then numbers; the first entry wins a tie."""
    return F.struct(
        entry["ts_rank"].alias("rank"),
        F.coalesce(entry["ts_num"], F.lit(0.0)).alias("num"),
        F.coalesce(entry["ts_text"], F.lit("")).alias("text"),
        (-entry["pos"]).alias("first"),
    )


def _last_of_each(rows: Column, key: Callable[[Column], Column], order: Callable[[Column], Column]) -> Column:
    """Of the rows of an array with one key, the one that comes last in order: one sort, whatever the number of keys."""
    keyed = F.transform(rows, lambda r: F.struct(key(r).alias("key"), order(r).alias("order"), r.alias("row")))

    def ends(ordered: Column) -> Column:
        last = F.filter(ordered, lambda r, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["key"] != r["key"]))
        return F.transform(last, lambda r: r["row"])

    return bound(F.sort_array(keyed), ends)


def _newest(entries: Column) -> Column:
    keyed = F.transform(entries, lambda e: F.struct(ts_sort_key(e).alias("k"), e.alias("e")))
    return F.array_max(keyed)["e"]


def overall_score(parsed: DataFrame) -> DataFrame:
    """Add ``score`` of the newest entry; NULL without history or if that score is null."""
    return parsed.withColumn("score", _newest(F.col("history"))["score"])


def _latest(history: Column) -> Column:
    known = F.filter(history, lambda e: e["monitor_id"].isNotNull())
    return _last_of_each(known, lambda e: e["monitor_id"], ts_sort_key)


def latest_by_monitor(parsed: DataFrame) -> DataFrame:
    """One row per document and monitor: its newest history entry."""
    return parsed.withColumn("_e", F.explode(_latest(F.col("history")))).select(
        *[c for c in parsed.columns if c not in ("history", "monitors", "body")], F.inline(F.array("_e"))
    )


def _names(monitors: Column) -> Column:
    """Map of each listed monitor id to its display name: the last listing's, or the id where that is empty."""
    listed = F.transform(monitors, lambda m, i: F.struct(m["id"].alias("id"), i.alias("pos"), m["name"].alias("name")))
    last = _last_of_each(F.filter(listed, lambda m: m["id"].isNotNull()), lambda m: m["id"], lambda m: m["pos"])
    name = lambda m: F.coalesce(F.nullif(m["name"], F.lit("")), m["id"].cast("string"))
    return F.map_from_entries(F.transform(last, lambda m: F.struct(m["id"].alias("monitor_id"), name(m).alias("name"))))


def monitor_names(parsed: DataFrame) -> DataFrame:
    """One row per document and listed monitor id, with its display name."""
    rest = [c for c in parsed.columns if c not in ("history", "monitors", "body")]
    return parsed.select(*rest, F.inline(F.map_entries(_names(F.col("monitors"))))).withColumnsRenamed(
        {"key": "monitor_id", "value": "name"}
    )


def _values(parsed: DataFrame) -> Column:
    def named(names: Column) -> Column:
        return F.transform(
            _latest(F.col("history")),
            lambda e: F.struct(
                F.coalesce(F.element_at(names, e["monitor_id"]), e["monitor_id"].cast("string")).alias("monitor"),
                e["monitor_id"].alias("monitor_id"),
                e["score"].alias("score"),
                e["offset"].alias("offset_s"),
                (e["rtt"] / 1000.0).alias("rtt_s"),
            ),
        )

    entries = bound(_names(F.col("monitors")), named)
    return _last_of_each(entries, lambda e: e["monitor"], lambda e: e["monitor_id"])


def monitor_values(parsed: DataFrame) -> DataFrame:
    """Score, offset and round trip in seconds per named monitor.

    Of two ids with one name the higher id is kept.
    """
    rest = [c for c in parsed.columns if c not in ("history", "monitors", "body")]
    return parsed.select(*rest, F.inline(_values(parsed)))


def poll_results(docs: DataFrame) -> DataFrame:
    """One row per poll: success, overall score and the monitors' values.

    Both documents must arrive and parse; otherwise the poll publishes nothing.
    """
    parsed = overall_score(parse_docs(docs))
    slim = parsed.select(
        "ip", "poll_ts", "kind", "ok",
        F.when(F.col("kind") == "overall", F.col("score")).alias("score"),
        F.when(F.col("kind") == "monitors", _values(parsed)).alias("values"),
    )
    polls = slim.groupBy("ip", "poll_ts").agg(
        F.bool_and("ok").alias("_ok"),
        *[F.bool_or(F.col("kind") == k).alias(f"_has_{k}") for k in KINDS],
        F.max("score").alias("score"),
        F.any_value("values", True).alias("values"),
    )
    success = F.col("_ok") & F.col("_has_monitors") & F.col("_has_overall")
    return polls.select(
        "ip", "poll_ts", success.alias("success"),
        F.when(success, F.col("score")).alias("score"),
        F.when(success, F.col("values")).alias("values"),
    )


def pool_gauges(polls: DataFrame) -> DataFrame:
    """Gauge settings of each poll: non-null values only, and its success.

    The success gauge carries no address.
    """
    setting = lambda metric, monitor, value: F.struct(
        F.lit(metric).alias("metric"), monitor.cast("string").alias("monitor"), value.cast("double").alias("value")
    )
    per_monitor = F.flatten(
        F.transform(
            F.coalesce(F.col("values"), F.slice(F.col("values"), 1, 0)),
            lambda v: F.array(*[setting(metric, v["monitor"], v[field]) for field, metric in GAUGES.items()]),
        )
    )
    fixed = F.array(
        setting(SCORE_METRIC, F.lit(""), F.col("score")),
        setting(SUCCESS_METRIC, F.lit(""), F.col("success")),
    )
    every = F.when(F.col("values").isNull(), fixed).otherwise(F.concat(fixed, per_monitor))
    rows = polls.select("ip", F.col("poll_ts").alias("ts"), F.inline(every)).where(F.col("value").isNotNull())
    return rows.withColumn("ip", F.when(F.col("metric") == SUCCESS_METRIC, "").otherwise(F.col("ip")))
