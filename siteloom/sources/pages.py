"""Page parsing: html to one wide record, its links and custom extractions, in one Arrow-batched pass."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import host_of, normalize_url, resolve_url, same_url
from .dom import Node, SelectorError, parse, select

_s, _b, _i = T.StringType(), T.BooleanType(), T.IntegerType()
_list = T.ArrayType(_s)
LINK = T.StructType([T.StructField(n, t) for n, t in (("href", _s), ("anchor_text", _s), ("rel", _s), ("is_internal", _b), ("is_no_follow", _b), ("link_type", _s))])
HREFLANG = T.StructType([T.StructField("hreflang", _s), T.StructField("href", _s)])
EXTRACTION = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("name", _s), ("rule_type", _s), ("values", _list), ("value", _s), ("match_count", _i), ("error", _s))])
SEO = T.StructType([T.StructField(n, t) for n, t in (
    ("title", _s), ("meta_description", _s), ("canonical_url", _s), ("self_referencing_canonical", _b), ("robots_meta", _s), ("noindex", _b), ("nofollow", _b),
    ("h1_count", _i), ("has_h1", _b), ("h1_text", _list), ("headings_h2", _list), ("headings_h3", _list), ("headings_h4", _list), ("headings_h5", _list), ("headings_h6", _list),
    ("image_count", _i), ("images_with_alt", _i), ("images_without_alt", _i), ("images_missing_dimensions", _i), ("images_missing_lazy_loading", _i),
    ("internal_link_count", _i), ("external_link_count", _i), ("open_graph", T.MapType(_s, _s)), ("twitter_card", T.MapType(_s, _s)), ("structured_data", _list),
    ("hreflang_alternates", _list), ("hreflang_links", T.ArrayType(HREFLANG)), ("is_amp", _b), ("amp_html_url", _s), ("pagination_next", _s), ("pagination_prev", _s),
    ("word_count", _i), ("extractable_text", _s), ("content_hash", _s), ("sitemap_links", _list), ("links", T.ArrayType(LINK)), ("extractions", T.ArrayType(EXTRACTION)))])

MOST_VALUES = 20


def _first(nodes: list[Node], attr: str, value: str) -> Node | None:
    return next((n for n in nodes if n.attrs.get(attr) == value), None)


def _rel(node: Node) -> list[str]:
    return node.attrs.get("rel", "").lower().split()


def _property(node: Node) -> str:
    """A microdata value: the first of content, href, src, datetime that the element has, if it isn't empty, else its text."""
    for name in ("content", "href", "src", "datetime"):
        if name in node.attrs:
            return node.attrs[name].strip() or node.text().strip()
    return node.text().strip()


def microdata(nodes: list[Node]) -> list[str]:
    out = []
    for n in nodes:
        kind = n.attrs.get("itemtype", "")
        token = next((t for t in kind.split() if "schema.org/" in t), None)
        if "itemscope" in n.attrs and token:
            item = {"@type": token.rstrip("/").rsplit("/", 1)[-1], "_source": "microdata"}
            for d in n.walk():
                if d is not n and (name := d.attrs.get("itemprop")) and (value := _property(d)):
                    item.setdefault(name, value)
            out.append(json.dumps(item, ensure_ascii=False))
    return out


def cut_bytes(text: str, most: int = 100) -> str:
    """At most ``most`` bytes, ended at a whole character."""
    return text.encode()[:most].decode(errors="ignore")


def xpath_to_css(xpath: str) -> tuple[str, str | None]:
    """One-step XPath, as extraction rules use it: //tag[@a='v'][n]/@attr; positions are ignored."""
    m = re.fullmatch(r"//([a-zA-Z][\w-]*|\*)((?:\[[^\]]*\])*)(?:/@([\w:-]+)|/text\(\))?", xpath.strip())
    if not m:
        raise SelectorError(f"Unsupported XPath: {xpath}")
    css = m[1]
    for test in re.findall(r"\[([^\]]*)\]", m[2]):
        if a := re.fullmatch(r"\s*@([\w:-]+)\s*(?:=\s*(?:'([^']*)'|\"([^\"]*)\"))?\s*", test):
            css += f'[{a[1]}="{a[2] or a[3] or ""}"]' if "=" in test else f"[{a[1]}]"
        elif not test.strip().isdigit():
            raise SelectorError(f"Unsupported XPath: {xpath}")
    return css, m[3]


def extract(root: Node, page: str, rule: dict) -> dict:
    """Values of one custom rule (css, xpath or regex), at most 20; what is wrong with it goes to ``error``."""
    out = {"id": rule.get("id"), "name": rule.get("name"), "rule_type": rule.get("rule_type"), "values": [], "value": None, "match_count": 0, "error": None}
    try:
        kind, selector, attr = rule["rule_type"], rule["selector"], rule.get("attribute")
        if kind == "regex":
            found = ((m[1] if m.re.groups and m[1] is not None else m[0]) for m in re.finditer(selector, page))
            values = [v.strip() for v in found if v.strip()]
        elif kind in ("css", "xpath"):
            if kind == "xpath":
                selector, told = xpath_to_css(selector)
                attr = told or attr
            values = []
            for n in select(root, selector):
                v = " ".join((n.attrs.get(attr.lower(), "") if attr else n.text()).split())
                if v:
                    values.append(v)
        else:
            raise ValueError(f"Unknown rule type: {kind}")
        values = values[:MOST_VALUES]
        out |= {"values": values, "value": values[0] if values else None, "match_count": len(values)}
    except (SelectorError, ValueError, KeyError, re.error) as e:
        out["error"] = str(e)
    return out


def parse_page(url: str, page: str, rules: list[dict] | None = None, compat: bool = False, closed: bool = False) -> dict:
    """The whole record of one page, from a single tree; ``closed`` is that of :func:`dom.parse`."""
    root = parse(page, closed)
    nodes = list(root.walk())
    by: dict[str, list[Node]] = {}
    for n in nodes:
        by.setdefault(n.tag, []).append(n)
    head, body = root.children[0], root.children[1]
    resolve = lambda h: resolve_url(url, h, compat)
    metas, links = by.get("meta", []), by.get("link", [])
    title = next((n.text().strip() for n in by.get("title", []) if n.parent is head), None) or None
    description = _first(metas, "name", "description")
    robots = _first(metas, "name", "robots")
    robots_text = robots.attrs.get("content") if robots else None
    canonical = next((n for n in links if _rel(n) == ["canonical"]), None)
    canonical_url = resolve(canonical.attrs.get("href")) if canonical else None
    heads = {k: [t for n in by.get(f"h{k}", []) if (t := n.text().strip())] for k in range(1, 7)}
    images = by.get("img", [])
    with_alt = sum(bool(n.attrs.get("alt")) for n in images)
    host = host_of(url)
    found, internal, external, sitemap_links = [], 0, 0, []
    for n in by.get("a", []):
        raw = n.attrs.get("href")
        if raw is None:
            continue
        if "sitemap" in raw.lower():
            sitemap_links.append(raw)
        href = resolve(raw)
        if href is None:
            continue
        inside = host_of(href) == host
        internal, external = internal + inside, external + (not inside)
        rel = n.attrs.get("rel")
        found.append({"href": href, "anchor_text": cut_bytes(n.text().strip()) or None, "rel": rel, "is_internal": inside, "is_no_follow": "nofollow" in _rel(n), "link_type": "HtmlA"})
    internal += sum("src" in n.attrs for n in by.get("script", []))
    external += sum(resolve(n.attrs["src"]) is not None for n in by.get("iframe", []) if "src" in n.attrs)
    external += sum(_rel(n) == ["stylesheet"] and "href" in n.attrs for n in links)
    og = {p[3:]: n.attrs["content"] for n in metas if (p := n.attrs.get("property", "")).startswith("og:") and "content" in n.attrs}
    twitter = {p[8:]: n.attrs["content"] for n in metas if (p := n.attrs.get("name", "")).startswith("twitter:") and "content" in n.attrs}
    blocks = []
    for n in by.get("script", []):
        if n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                blocks.append(json.dumps(json.loads(n.text()), ensure_ascii=False))
            except ValueError:
                pass
    alternates = [n for n in links if "alternate" in _rel(n) and "hreflang" in n.attrs]
    amp = next((n.attrs["href"] for n in links if "amphtml" in _rel(n) and "href" in n.attrs), None)
    page_of = lambda kind: next((resolve(n.attrs.get("href")) for n in reversed(links) if _rel(n) == [kind] and "href" in n.attrs), None)
    text = body.text()
    lower = (robots_text or "").lower()
    out = {
        "title": title, "meta_description": description.attrs.get("content") if description else None, "canonical_url": canonical_url,
        "self_referencing_canonical": canonical_url is not None and same_url(canonical_url, url), "robots_meta": robots_text, "noindex": "noindex" in lower, "nofollow": "nofollow" in lower,
        "h1_count": len(heads[1]), "has_h1": bool(heads[1]), "h1_text": heads[1], **{f"headings_h{k}": heads[k] for k in range(2, 7)},
        "image_count": len(images), "images_with_alt": with_alt, "images_without_alt": len(images) - with_alt,
        "images_missing_dimensions": sum("width" not in n.attrs or "height" not in n.attrs for n in images),
        "images_missing_lazy_loading": sum(n.attrs.get("loading", "").lower() != "lazy" for n in images[2:]),
        "internal_link_count": internal, "external_link_count": external, "open_graph": og, "twitter_card": twitter, "structured_data": blocks + microdata(nodes),
        "hreflang_alternates": [n.attrs["hreflang"] for n in alternates],
        "hreflang_links": [{"hreflang": n.attrs["hreflang"], "href": h} for n in alternates if (h := resolve(n.attrs.get("href"))) is not None],
        "is_amp": "amp" in root.attrs or "⚡" in root.attrs, "amp_html_url": resolve(amp) if amp is not None else None,
        "pagination_next": page_of("next"), "pagination_prev": page_of("prev"),
        "word_count": len(text.split()), "extractable_text": text, "content_hash": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
        "sitemap_links": sitemap_links, "links": found, "extractions": [extract(root, page, r) for r in rules or []],
    }
    # Without its cycles the tree goes at once, not when the collector next looks at all that is old.
    for n in nodes:
        n.parent = None
    return out


#: Pages and bytes of html in an Arrow batch that the parse takes, and pages whose records are made and sent at a time.
BATCH = {"maxRecordsPerBatch": 500, "maxBytesPerBatch": 16 << 20}
AT_ONCE = 50


def _bounded(spark: SparkSession) -> None:
    """Lower the session's limits of a batch to ``BATCH``; stricter ones stay. They are read when a query runs."""
    for key, most in BATCH.items():
        told = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}").strip().lower())
        if not told or not 0 < int(told[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[told[2]] <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def parsed(pages: DataFrame, *, url: str = "url", html: str = "html", rules: list[dict] | None = None, compat: bool = False, keep_html: bool = False, closed: bool = False) -> DataFrame:
    """``pages`` with the fields of :data:`SEO` and ``normalized_url``; without ``html`` unless ``keep_html``.

    Rows with null html get null fields. A task holds one batch of bounded size and the records of a few pages. No shuffle; persist or write the result, as every rule reads it."""
    from pyspark.sql.pandas.types import to_arrow_type

    keep = [c for c in pages.columns if keep_html or c != html]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("normalized_url", _s), *SEO.fields])
    kinds = {f.name: to_arrow_type(f.dataType) for f in SEO}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            urls = b.column(url).to_pylist()
            rows = [parse_page(u or "", h, rules, compat, closed) if h is not None else dict.fromkeys(SEO.names) for u, h in zip(urls, b.column(html).to_pylist())]
            cols = [b.column(c) for c in keep] + [pa.array([normalize_url(u) for u in urls], pa.string())]
            cols += [pa.array([list(r[n].items()) if isinstance(r[n], dict) else r[n] for r in rows], kinds[n]) for n in SEO.names]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    _bounded(pages.sparkSession)
    return pages.select(*keep, *([html] if html not in keep else [])).mapInArrow(run, schema)


def html_sitemap(page: str) -> list[str]:
    """The addresses of all links of a page that lists others, as they are written."""
    return [n.attrs["href"] for n in parse(page).walk() if n.tag == "a" and "href" in n.attrs]


def links(pages: DataFrame, *, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each link of the parsed pages, with its target's normal form."""
    from ..functions.urls import normalized

    one = pages.select(F.col(id_col).alias("source_id"), F.col(url).alias("source_url"), F.posexplode("links").alias("position", "l"))
    return one.select("source_id", "source_url", "position", F.col("l.href").alias("target_url"), normalized(F.col("l.href")).alias("target_normalized_url"), F.col("l.link_type").alias("link_relation"), F.col("l.anchor_text").alias("anchor_text"), F.col("l.rel").alias("rel"), F.col("l.is_internal").alias("is_internal"), F.col("l.is_no_follow").alias("is_no_follow"))


def is_html(content_type: Column) -> Column:
    """Null and blank count as html."""
    low = F.lower(F.trim(F.coalesce(content_type, F.lit(""))))
    return (low == "") | low.contains("text/html") | low.contains("application/xhtml")


def is_crawlable_type(content_type: Column) -> Column:
    low = F.lower(content_type)
    return low.contains("text/html") | low.contains("application/xhtml") | low.contains("text/xml")


def indexability(noindex: Column, status: Column, compat: bool = False) -> Column:
    """``compat``: a failed fetch (status 0) is indexable, as it used to be; otherwise it is not."""
    bad = F.coalesce(noindex, F.lit(False)) | (F.coalesce(status, F.lit(0)) >= 400)
    if not compat:
        bad = bad | (status == 0)
    return F.when(bad, "non_indexable").otherwise("indexable")
