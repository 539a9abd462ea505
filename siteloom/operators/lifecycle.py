"""Projects, crawls, schedules and rules: their rows, and what changes them. Every change gives a new table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import ranked
from .crawl import next_run, validate_rule


def added(table: DataFrame, key: str, **values) -> DataFrame:
    """The table with one more row: the next number as ``key``, the given values, null for the rest."""
    at = table.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias(key))
    row = at.select(*(F.col(key).cast(f.dataType).alias(f.name) if f.name == key else (v if isinstance(v := values.get(f.name), Column) else F.lit(v)).cast(f.dataType).alias(f.name) for f in table.schema))
    return table.unionByName(row)


def changed(table: DataFrame, key: str, value, **values) -> DataFrame:
    """The table with the given columns of one row replaced; columns given as None stay."""
    mine = F.col(key) == value
    return table.withColumns({c: F.when(mine, (v if isinstance(v, Column) else F.lit(v)).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def removed(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(~F.col(key).eqNullSafe(F.lit(value)))


def one(table: DataFrame, key: str, value) -> DataFrame:
    """The row of that number, or none."""
    return table.where(F.col(key) == value).limit(1)


def projects(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("created_at"), F.desc("project_id"))


def crawls(table: DataFrame, project_id: int) -> DataFrame:
    return table.where(F.col("project_id") == project_id).orderBy(F.desc("created_at"), F.desc("crawl_id"))


def new_crawl(table: DataFrame, project_id: int, now: Column, settings: str | None = None) -> DataFrame:
    zero = {c: 0 for c in ("url_count", "issue_count", "link_count") if c in table.columns}
    return added(table, "crawl_id", project_id=project_id, status="created", settings_json=settings or "null", created_at=now, **zero)


def counted(table: DataFrame, pages: DataFrame, issues: DataFrame, links: DataFrame) -> DataFrame:
    """The crawls with their counters told anew: an aggregate of each table, combined before its shuffle."""
    out = table.drop("url_count", "issue_count", "link_count")
    of_page = issues.join(pages.select("page_id", "crawl_id"), "page_id")
    for name, rows in (("url_count", pages), ("issue_count", of_page), ("link_count", links)):
        out = out.join(rows.groupBy("crawl_id").agg(F.count("*").alias(name)), "crawl_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def without_project(project_id: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without a project and all that hangs on it: rows that name the project, rows of its crawls, and rows
    of its pages, each in one pass. A table is matched by the columns it has."""
    of_crawls, of_pages = tables["crawls"].where(F.col("project_id") == project_id).select("crawl_id"), None
    if "pages" in tables:
        of_pages = tables["pages"].join(of_crawls, "crawl_id", "left_semi").select("page_id")
    out = {}
    for name, t in tables.items():
        if "project_id" in t.columns:
            out[name] = removed(t, "project_id", project_id)
        elif "crawl_id" in t.columns:
            out[name] = t.join(of_crawls, "crawl_id", "left_anti")
        elif "page_id" in t.columns and of_pages is not None:
            out[name] = t.join(of_pages, "page_id", "left_anti")
        else:
            out[name] = t
    return out


def completed(table: DataFrame, crawl_id: int) -> DataFrame:
    """The completed crawl of that number; anything else is an error."""
    row = one(table, "crawl_id", crawl_id)
    found = row.select("status").collect()
    if not found or found[0]["status"] != "completed":
        raise ValueError(f"no completed crawl {crawl_id}")
    return row


# Schedules


def schedules(table: DataFrame, project_id: int) -> DataFrame:
    """Enabled first, then by the next run (those without one last), the newest first among equals."""
    return table.where(F.col("project_id") == project_id).orderBy(F.desc("enabled"), F.col("next_run_at").asc_nulls_last(), F.desc("created_at"), F.desc("schedule_id"))


def due_schedules(table: DataFrame, now: datetime) -> DataFrame:
    return table.where(F.col("enabled") & (F.col("next_run_at") <= F.lit(now))).orderBy("next_run_at", "schedule_id")


def _runs(table: DataFrame, now: datetime) -> DataFrame:
    """(cron_expression, following): the run after ``now`` of each expression in use; expressions are few, being
    written by people, and computed once each."""
    told = [(r["cron_expression"], next_run(r["cron_expression"], now)) for r in table.select("cron_expression").distinct().toLocalIterator()]
    return table.sparkSession.createDataFrame(told, "cron_expression string, following timestamp_ntz")


def claimed(table: DataFrame, now: datetime) -> DataFrame:
    """The schedules after a claim: those that are due have run now and run next when their expression says."""
    mine = F.coalesce(F.col("enabled") & (F.col("next_run_at") <= F.lit(now)), F.lit(False))
    kind = table.schema["next_run_at"].dataType
    return table.join(_runs(table.where(mine), now), "cron_expression", "left").withColumns({
        "last_run_at": F.when(mine, F.lit(now).cast(kind)).otherwise(F.col("last_run_at")),
        "next_run_at": F.when(mine, F.col("following").cast(kind)).otherwise(F.col("next_run_at")),
    }).select(*table.columns)


def started(table: DataFrame, schedule_id: int, now: datetime) -> DataFrame:
    """The schedules after one was run by hand: a disabled one has no next run."""
    mine, kind = F.col("schedule_id") == schedule_id, table.schema["next_run_at"].dataType
    return table.join(_runs(table.where(mine), now), "cron_expression", "left").withColumns({
        "last_run_at": F.when(mine, F.lit(now).cast(kind)).otherwise(F.col("last_run_at")),
        "next_run_at": F.when(mine, F.when(F.col("enabled"), F.col("following").cast(kind))).otherwise(F.col("next_run_at")),
    }).select(*table.columns)


def crawls_of_due(schedules_: DataFrame, crawls_: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Starts what is due: the schedules after their claim, and the crawls with one more for each, ``crawling`` from now, in
    the order in which they were due. Numbers go on from the last crawl; only that number reaches the driver."""
    last = crawls_.agg(F.coalesce(F.max("crawl_id"), F.lit(0))).first()[0]
    due = ranked(due_schedules(schedules_, now).select("schedule_id", "project_id", "next_run_at"), [F.col("next_run_at"), F.col("schedule_id")], "_place")
    told = {"crawl_id": F.col("_place") + last + 1, "project_id": F.col("project_id"), "schedule_id": F.col("schedule_id"), "status": F.lit("crawling"), "created_at": F.lit(now), "started_at": F.lit(now)}
    zero = ("total_urls", "url_count", "issue_count", "link_count")
    new = due.select(*(told.get(f.name, F.lit(0) if f.name in zero else F.lit(None)).cast(f.dataType).alias(f.name) for f in crawls_.schema))
    return claimed(schedules_, now), crawls_.unionByName(new)


def new_schedule(table: DataFrame, projects_: DataFrame, now: datetime, *, project_id: int, start_url: str, cron_expression: str, settings: str = "{}", enabled: bool = True) -> DataFrame:
    """The schedules with a new one, its inputs checked: a known project, an address, a JSON object, an expression."""
    if one(projects_, "project_id", project_id).isEmpty():
        raise ValueError(f"no project {project_id}")
    if not start_url.strip():
        raise ValueError("start_url is required")
    if not isinstance(json.loads(settings or "{}"), dict):
        raise ValueError("settings must be a JSON object")
    return added(table, "schedule_id", project_id=project_id, start_url=start_url.strip(), cron_expression=cron_expression, enabled=enabled, next_run_at=next_run(cron_expression, now) if enabled else None, created_at=now)


def new_rule(table: DataFrame, now: Column, **rule) -> DataFrame:
    return added(table, "rule_id", **validate_rule(rule), created_at=now)


# Details


def with_recommendation(details: Column, recommendation: Column) -> Column:
    """JSON details with the type's recommendation where they have none: an object keeps its own fields, null becomes an
    object, anything else its ``value``."""
    text = F.trim(details)
    told = F.concat(F.lit('"recommendation":'), F.to_json(F.array(recommendation)).substr(F.lit(2), F.length(F.to_json(F.array(recommendation))) - 2))
    has = F.array_contains(F.json_object_keys(text), "recommendation")
    empty = F.size(F.json_object_keys(text)) == 0
    inside = F.regexp_replace(text, r"\}\s*$", "")
    return (
        F.when(details.isNull() | (text == "null"), F.concat(F.lit("{"), told, F.lit("}")))
        .when(text.startswith("{") & F.coalesce(has, F.lit(False)), details)
        .when(text.startswith("{"), F.concat(inside, F.when(empty, F.lit("")).otherwise(F.lit(",")), told, F.lit("}")))
        .otherwise(F.concat(F.lit('{"value":'), text, F.lit(","), told, F.lit("}")))
    )


def total_pages(rows: DataFrame, size: int) -> DataFrame:
    """(total, total_pages) of a filtered list: one aggregate beside the page of rows."""
    return rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / F.lit(max(size, 1))))


def text_of(pages: DataFrame, json_column: str = "seo_data_json", fields: Sequence[tuple[str, str, str]] = (("title", "title", "title"), ("meta_description", "metaDescription", "meta_description"), ("h1_text", "h1Text", "h1_text"), ("headings_h2", "headingsH2", "headings_h2"), ("headings_h3", "headingsH3", "headings_h3"), ("extractable_text", "extractableText", "extractable_text")), blank: Sequence[str] = ()) -> Column:
    """A page's texts: from its columns in their order, then what these lack from the stored JSON, whose keys may be
    camel case or, failing that, snake case; lists of texts are joined. JSON fills in the order title, h1, description, body, h2, h3.
    Blank texts are left out; columns named in ``blank`` count as they are, blank too."""
    told = lambda c: F.array_join(F.col(c), " ") if c in pages.columns and pages.schema[c].dataType.typeName() == "array" else F.col(c) if c in pages.columns else F.lit(None).cast("string")
    own = {c: T.trimmed(told(c)) if c in blank else F.when(T.trimmed(told(c)) != "", T.trimmed(told(c))) for c, _, _ in fields}

    def stored(camel: str, snake: str) -> Column:
        raw = F.coalesce(*(F.get_json_object(F.col(json_column), f"$.{k}") for k in (camel, snake)))
        return F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), " ")).otherwise(raw)

    order = [0, 2, 1, 5, 3, 4]
    missing = [F.when(own[fields[i][0]].isNull(), F.when(T.trimmed(stored(*fields[i][1:])) != "", T.trimmed(stored(*fields[i][1:])))) for i in order if i < len(fields)]
    return F.concat_ws(" ", *own.values(), *missing)
