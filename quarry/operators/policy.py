"""Masking of results, display names, and blocking of origins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import ArgumentError, BlockedOrigin, MaskedObject
from quarry.functions.text import url_candidates
from quarry.operators.content import new_rows
from quarry.schemas import BLOCKED_STATES, MASKED_STATES


def masked_states(asked: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct masked key of ``asked``, its (request, state) list; visible ones are not masked."""
    rows = masks.where("state <> 'visible'").join(asked.select(*keys).distinct(), keys, "left_semi")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("request", "state"))).alias("masks"))


def masked(result: DataFrame, masks: DataFrame, keys: list[str], mode: str = "drop", report: int = 1000) -> DataFrame:
    """``result`` without masked rows; in mode ``raise`` one masked row makes the whole call fail, naming up to ``report``."""
    if mode == "raise":
        found = masked_states(result, masks, keys).limit(report).collect()
        if found:
            raise MaskedObject({tuple(r[k] for k in keys): [tuple(m) for m in r.masks] for r in found})
        return result
    if mode != "drop":
        raise ArgumentError(f"no mode {mode}")
    return result.join(masks.where("state <> 'visible'").select(*keys).distinct(), keys, "left_anti")


def with_display_names(df: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """Persons replaced by the display name of their email; a null or empty email has none."""
    for c in columns:
        own = names.where("length(original_email) > 0").groupBy(F.col("original_email").alias("_email")).agg(F.min("display_name").alias("_shown"))
        joined = df.join(own, F.col(f"{c}.email") == F.col("_email"), "left")
        kinds = {f.name: f.dataType for f in df.schema[c].dataType}
        shown = F.struct(F.col("_shown").alias("fullname"), F.lit(None).cast(kinds["name"]).alias("name"), F.lit(None).cast(kinds["email"]).alias("email"))
        df = joined.withColumn(c, F.when(F.col("_shown").isNotNull(), shown).otherwise(F.col(c))).drop("_email", "_shown")
    return df


def blocking_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, url_match, request, state)``: the longest rule that matches each url, of equal ones the greatest request."""
    asked = urls.select("url").distinct().withColumn("url_match", F.explode(url_candidates(F.col("url"))))
    rows = asked.join(rules.select("url_match", "request", "state"), "url_match")
    best = F.max_by(F.struct("url_match", "request", "state"), F.struct(F.length("url_match"), "request"))
    return rows.groupBy("url").agg(best.alias("r")).select("url", "r.*")


def blocked(urls: DataFrame, rules: DataFrame, mode: str = "drop", report: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(urls that may be added, log entries to append); in mode ``raise`` a blocked url is an error.

    Every match is logged, also of a rule that doesn't block.
    """
    log = blocking_rule(urls, rules)
    bad = log.where("state <> 'non_blocked'")
    if mode == "raise" and (found := bad.limit(report).collect()):
        raise BlockedOrigin({r.url: (r.url_match, r.request, r.state) for r in found})
    return urls.join(bad, "url", "left_anti"), log.withColumn("date", F.current_timestamp())


def request_create(new: DataFrame, requests: DataFrame) -> DataFrame:
    """New requests; a slug that exists is an error."""
    clash = new.join(requests, "slug", "left_semi").select("slug").limit(1).collect()
    if clash:
        raise ArgumentError(f"request {clash[0].slug} exists")
    return new_rows(new, requests, ["slug"])


def request_list(requests: DataFrame, states: DataFrame, include_cleared: bool = False) -> DataFrame:
    """Requests with how many objects they rule, newest first by ``ord``; those without any only on demand."""
    n = states.groupBy(F.col("request").alias("id")).agg(F.count("*").alias("n"))
    rows = requests.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows if include_cleared else rows.where("n > 0")


def request_find(requests: DataFrame, **by) -> DataFrame:
    ((column, value),) = by.items()
    return requests.where(F.col(column) == value)


def set_states(table: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    """The table after an upsert: a later row of ``changes`` (by ``seq``) wins over an earlier one and over the table."""
    allowed = MASKED_STATES if "object_id" in keys else BLOCKED_STATES
    bad = changes.where(~F.col("state").isin(*allowed)).limit(1).collect()
    if bad:
        raise ArgumentError(f"no state {bad[0].state}")
    every = table.withColumn("seq", F.lit(None).cast("long")).unionByName(changes.select(*table.columns, F.col("seq").cast("long")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("seq")))
    return every.withColumn("_n", nth).where("_n = 1").select(*table.columns)


def states_for_request(table: DataFrame, request: str) -> DataFrame:
    return table.where(F.col("request") == request)


def find_states(asked: DataFrame, table: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """States of the asked objects with their request's slug."""
    named = requests.select(F.col("id").alias("request"), "slug")
    return table.join(asked.select(*keys).distinct(), keys, "left_semi").join(named, "request", "left")


def delete_states(table: DataFrame, request: str) -> DataFrame:
    return table.where(F.col("request") != request)


def iterate_masked(table: DataFrame) -> DataFrame:
    """Every masked object with all its states."""
    rows = table.where("state <> 'visible'")
    return rows.groupBy("object_id", "object_type").agg(F.array_sort(F.collect_list(F.struct("request", "state"))).alias("masks"))


def history(table: DataFrame, request: str) -> DataFrame:
    return table.where(F.col("request") == request).orderBy(F.desc("date"))


def blocking_log(log: DataFrame, request: str | None = None, url: str | None = None) -> DataFrame:
    rows = log if request is None else log.where(F.col("request") == request)
    return (rows if url is None else rows.where(F.col("url") == url)).orderBy(F.desc("date"), "url")
