"""Custom extractions as a lateral join: every page meets the rules of its crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .dom import parse
from .pages import extract

RULE = ("rule_id", "name", "rule_type", "selector", "attribute")


@udtf(returnType="rule_id long, name string, rule_type string, values array<string>, value string, match_count int, error string", useArrow=True)
class Extracted:
    """A row for each rule, over one parse of the page; a page without html gives none."""

    def eval(self, html, rules):
        if html is None or not rules:
            return
        root = parse(html)
        for r in rules:
            got = extract(root, html, {"id": r["rule_id"], **{k: r[k] for k in RULE[1:]}})
            yield got["id"], got["name"], got["rule_type"], got["values"], got["value"], got["match_count"], got["error"]


def extractions(pages: DataFrame, rules: DataFrame, *, keep: tuple[str, ...] = ("page_id", "crawl_id"), html: str = "html") -> DataFrame:
    """(keep, rule_id, name, rule_type, values, value, match_count, error): the active rules of each page's crawl, applied.

    ``rules``: (rule_id, crawl_id, name, rule_type, selector, attribute, active), some for each crawl: they are
    gathered by crawl, being written by people, and meet the pages by an equi-join. What is wrong with a rule goes to its ``error``;
    values are at most 20. Crawls without rules and pages without html have no rows."""
    one = F.struct(*(F.col(c) for c in RULE))
    by_crawl = rules.where("active").groupBy("crawl_id").agg(F.array_sort(F.collect_list(one)).alias("_rules"))
    met = pages.select(*keep, F.col(html).alias("_html")).join(by_crawl, "crawl_id")
    return met.lateralJoin(Extracted(F.col("_html").outer(), F.col("_rules").outer())).drop("_html", "_rules")
