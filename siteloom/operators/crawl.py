"""Crawl control: scope, frontier, schedules, extraction rules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut as checkpointed
from ..functions.lineage import ranked
from ..functions.urls import host, host_of, normalized


def wildcard_regex(pattern: str) -> str:
    """``*`` and ``?`` as wildcards, all else plain, anchored; a final ``$`` means the end that is there anyway."""
    body = pattern[:-1] if pattern.endswith("$") else pattern
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in body) + "$"


@dataclass
class Scope:
    """Which URLs a crawl may follow. Patterns count both as regular expressions and with wildcards, against path,
    path with query, and whole URL; blank and invalid ones are left out."""

    root: str
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    allowed: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)
    max_url_length: int = 0

    def hosts(self) -> list[str]:
        h = host_of(self.root) or ""
        twin = h[4:] if h.startswith("www.") else "www." + h
        return [h, twin, *(x.strip().lower() for x in self.allowed if x.strip())]

    @staticmethod
    def regexes(patterns: list[str]) -> list[str]:
        out = []
        for p in patterns:
            if not p.strip():
                continue
            try:
                re.compile(p.strip())
                out.append(p.strip())
            except re.error:
                pass
            out.append(wildcard_regex(p.strip()))
        return out

    def column(self, url: Column) -> Column:
        h, path, query = host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")), F.try_parse_url(url, F.lit("QUERY"))
        forms = [path, F.concat_ws("?", path, query), url]
        any_of = lambda ps: F.coalesce(F.greatest(*(f.rlike(p) for p in ps for f in forms), F.lit(False)), F.lit(False))
        ok = F.coalesce(h.isin(*self.hosts()), F.lit(False))
        for b in (x.strip().lower() for x in self.blocked if x.strip()):
            ok = ok & ~F.coalesce((h == b) | h.endswith("." + b), F.lit(False))
        if inc := self.regexes(self.includes):
            ok = ok & any_of(inc)
        if exc := self.regexes(self.excludes):
            ok = ok & ~any_of(exc)
        if self.max_url_length > 0:
            ok = ok & (F.length(url) <= self.max_url_length)
        return ok


def same_domain(url: Column, root_host: str) -> Column:
    return (host(url) == root_host) | host(url).endswith("." + root_host)


#: URLs of a level that are sent to the links; beyond that, links and level are shuffled.
SENT = 200_000


def _near(level: DataFrame, n: int) -> DataFrame:
    """A level of ``n`` rows for a join with all links, which then stay where they are while the level is small."""
    return F.broadcast(level) if n <= SENT else level


def frontier_levels(seeds: DataFrame, edges: DataFrame, *, max_depth: int = 3, max_urls: int | None = None, cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(url, depth): breadth-first levels over edges (source, target) from seeds (url). Each level is an anti-join
    with what was seen; ``max_urls`` takes the smallest URLs of the level that would pass it. ``cut`` ends the
    lineage of a level (default: a checkpoint in the session's folder; without one, in local mode, in a temporary one)."""
    cut = cut or (lambda d, _: checkpointed(d))
    level = seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0))
    level = cut(level, "0") if max_urls is None else cut(level.orderBy("url").limit(max_urls), "0")
    levels, n = [level], level.count()
    used = n
    for depth in range(1, max_depth + 1):
        if not n or (max_urls is not None and used >= max_urls):
            break
        # The links are met by what is new only; every level is written once, and all together at every sixteenth.
        seen = reduce(DataFrame.unionByName, levels)
        nxt = edges.join(_near(level.select(F.col("url").alias("source")), n), "source", "left_semi").select(F.col("target").alias("url")).where("url is not null").distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        if max_urls is not None:
            nxt = nxt.orderBy("url").limit(max_urls - used)
        level = cut(nxt, str(depth))
        n = level.count()
        used += n
        levels.append(level)
        if len(levels) == 16:
            levels = [cut(reduce(DataFrame.unionByName, levels), f"seen{depth}")]
    return reduce(DataFrame.unionByName, levels)


def crawl_order(seeds: DataFrame, links: DataFrame, *, max_depth: int, max_urls: int, blocked: Callable[[DataFrame], DataFrame] | None = None, in_scope: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, depth, place, crawled): what a first-in-first-out crawl queues, in the order of its queue.

    ``seeds`` are (url, position), ``links`` (source, target, position) in normal form, of links that may be followed.
    A URL enters the queue where it is first met: after the links of pages crawled before, by its position on its page.
    It must be in scope and not deeper than ``max_depth``; the queue takes ``max_urls`` in all, so the budget ends
    within a level, in queue order. ``blocked`` gives the URLs (url) of those handed to it that must not be fetched
    (robots): they keep their place in the queue and the budget, but are not crawled, and lead nowhere.

    Levels follow one another. In each, a target's first link is an aggregate, what was queued leaves by an anti-join,
    and places come from ranges and their counts: no task sorts a level. Null URLs are left out; a repeated seed counts
    where it stands first; without seeds there is no row."""
    scope = (lambda c: F.lit(True)) if in_scope is None else in_scope

    def opened(level: DataFrame) -> DataFrame:
        if blocked is None:
            return level.withColumn("crawled", F.lit(True))
        return level.join(blocked(level.select("url")).select("url").distinct().withColumn("_no", F.lit(True)), "url", "left").withColumn("crawled", F.col("_no").isNull()).drop("_no")

    first = seeds.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("position").alias("_p"))
    level = ranked(first, [F.col("_p"), F.col("url")], "place").where(F.col("place") < max_urls).select("url", F.lit(0).alias("depth"), "place")
    level = seen = checkpointed(opened(level))
    used = new = seen.count()
    for depth in range(1, max_depth + 1):
        if used >= max_urls:
            break
        # A page's links meet its place; a hub's many links are an equi-join that may be split by the planner.
        met = links.join(_near(level.where("crawled").select(F.col("url").alias("source"), F.col("place").alias("_from")), new), "source")
        first = met.where(F.col("target").isNotNull() & scope(F.col("target"))).groupBy(F.col("target").alias("url")).agg(F.min(F.struct("_from", "position")).alias("_p"))
        first = first.join(seen.select("url"), "url", "left_anti").select("url", "_p._from", F.col("_p.position").alias("_position"))
        level = ranked(first, [F.col("_from"), F.col("_position"), F.col("url")], "place").where(F.col("place") < max_urls - used)
        level = checkpointed(opened(level.select("url", F.lit(depth).alias("depth"), (F.col("place") + used).alias("place"))))
        new = level.count()
        if not new:
            break
        used += new
        seen = checkpointed(seen.unionByName(level))
    return seen


def seeds(urls: DataFrame, scope: Scope) -> DataFrame:
    return urls.where(scope.column(F.col("url"))).select(normalized(F.col("url")).alias("url"))


# Schedules

#: The range of each cron field.
CRON_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def cron_parts(expression: str) -> list[set[int] | None]:
    """The values of each field, None for any. Steps are for minutes and hours only."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    out: list[set[int] | None] = []
    for k, (text, (lo, hi)) in enumerate(zip(fields, CRON_RANGES)):
        if text == "*":
            out.append(None)
        elif k < 2 and (m := re.fullmatch(r"\*/(\d+)", text)) and 0 < int(m[1]) <= hi:
            out.append({v for v in range(lo, hi + 1) if v % int(m[1]) == 0})
        elif text.isdigit() and lo <= int(text) <= hi:
            out.append({int(text)})
        else:
            raise ValueError(f"not a cron field: {text}")
    return out


def next_run(expression: str, now: datetime) -> datetime | None:
    """The first whole minute after ``now`` that all five fields fit (day of month and day of week both), within
    370 days. Days that don't fit are passed over whole."""
    minute, hour, day, month, weekday = cron_parts(expression)
    at = now.astimezone(timezone.utc) if now.tzinfo else now
    at = at.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = at + timedelta(days=370)
    fits = lambda allowed, v: allowed is None or v in allowed
    while at < end:
        if not (fits(day, at.day) and fits(month, at.month) and fits(weekday, (at.weekday() + 1) % 7)):
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif not fits(hour, at.hour):
            at = at.replace(minute=0) + timedelta(hours=1)
        elif not fits(minute, at.minute):
            at += timedelta(minutes=1)
        else:
            return at
    return None


def due(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.where(F.col("enabled") & (F.col("next_run_at") <= now))


def merged_settings(defaults: Column, told: Column) -> Column:
    """Maps of settings, those told over the defaults."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(told), k)), told)


def custom_headers(text: str | dict | list | None) -> list[tuple[str, str]]:
    """Header pairs from an object, a list of pairs or name/value objects, or either as JSON text."""
    if isinstance(text, str):
        try:
            text = json.loads(text)
        except ValueError:
            return []
    if isinstance(text, dict):
        return [(str(k), str(v)) for k, v in text.items()]
    out = []
    for x in text or []:
        if isinstance(x, dict) and "name" in x:
            out.append((str(x["name"]), str(x.get("value", ""))))
        elif isinstance(x, (list, tuple)) and len(x) == 2:
            out.append((str(x[0]), str(x[1])))
    return out


def validate_rule(rule: dict) -> dict:
    for k in ("name", "selector"):
        if not str(rule.get(k) or "").strip():
            raise ValueError(f"{k} is required")
    if rule.get("rule_type") not in ("css", "xpath", "regex"):
        raise ValueError("rule_type must be css, xpath or regex")
    return rule


def listed_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("active"), F.desc("created_at"), F.desc("rule_id"))


def rules_for_crawl(rules: DataFrame, crawls: DataFrame, crawl_id: int) -> DataFrame:
    """The crawl's own rules; if it has none, the active ones of its project's latest other crawl that has some."""
    mine = rules.where(F.col("crawl_id") == crawl_id)
    project = crawls.where(F.col("crawl_id") == crawl_id).select("project_id")
    others = crawls.where(F.col("crawl_id") != crawl_id).join(project, "project_id", "left_semi").join(rules.where("active").select("crawl_id").distinct(), "crawl_id", "left_semi")
    latest = others.agg(F.max_by("crawl_id", F.struct("created_at", "crawl_id")).alias("crawl_id"))
    copied = rules.where("active").join(latest, "crawl_id", "left_semi").withColumn("crawl_id", F.lit(crawl_id).cast(rules.schema["crawl_id"].dataType))
    none = mine.select(F.lit(1).alias("one")).limit(1)
    return mine.unionByName(copied.join(none, F.lit(1) == F.col("one"), "left_anti"))
