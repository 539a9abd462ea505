"""URL functions: plain Python for the parse pass, and Column forms for queries."""

from __future__ import annotations

import re
from posixpath import normpath
from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ports that a URL of the scheme need not state.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def parts(url: str | None) -> tuple[str, str, str, str] | None:
    """(scheme, host with any unusual port, encoded path, query) of an absolute URL; None if it has no host."""
    if not url:
        return None
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname, u.port
    except ValueError:
        return None
    if not u.scheme or not host or re.search(r"[\s<>\"^`{|}]", host):
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if ":" in host:
        host = f"[{host}]"
    if port is not None and port != DEFAULT_PORTS.get(u.scheme.lower()):
        host += f":{port}"
    path = quote(u.path, safe="/%:@!$&'()*+,;=~-._|[]^") or "/"
    if re.search(r"/\.\.?(/|$)", path):
        path = (normpath(path.replace("//", "/\0")).replace("\0", "") or "/") + ("/" if re.search(r"/\.{0,2}$", path) and normpath(path) != "/" else "")
        path = "/" + path.lstrip("/")
    return u.scheme.lower(), host.lower(), path, u.query


def normalize_path(path: str) -> str:
    path = re.sub("/+", "/", path)
    return path[:-1] if len(path) > 1 and path.endswith("/") else path


def normalize_url(url: str | None) -> str | None:
    """Lower-case scheme and host, single slashes, no trailing slash but the root's, pairs of the query sorted by
    key (stable) and encoded as a form, no fragment, no default port; None if it is no absolute URL."""
    p = parts(url)
    if p is None:
        return None
    pairs = sorted(parse_qsl(p[3], keep_blank_values=True), key=lambda kv: kv[0])
    query = "&".join(f"{quote_plus(k, safe='*')}={quote_plus(v, safe='*')}" for k, v in pairs).replace("~", "%7E")
    return urlunsplit((p[0], p[1], normalize_path(p[2]), query, ""))


def resolve_url(base: str, href: str | None, compat: bool = False) -> str | None:
    """Absolute form of a link. ``compat`` strips leading ``./`` and ``../`` before joining, as the original
    behaviour did, which loses a parent step."""
    if href is None:
        return None
    href = href.strip()
    if href.startswith("//"):
        href = "https:" + href
    elif not re.match(r"https?://", href):
        if SCHEME.match(href):
            return None if parts(href) is None else href
        if compat:
            href = href.removeprefix("./").removeprefix("../")
        try:
            href = urljoin(base, href)
        except ValueError:
            return None
    p = parts(href)
    if p is None:
        return None
    u = urlsplit(href)
    query = quote(u.query, safe="%=&?/:@!$'()*+,;~-._[]|^`{}")
    return urlunsplit((*p[:3], query, u.fragment))


def host_of(url: str | None) -> str | None:
    p = parts(url)
    return re.sub(r":\d+$", "", p[1]) if p else None


def same_url(a: str | None, b: str | None) -> bool:
    """Equal normal forms; two URLs that can't be parsed count as equal."""
    return normalize_url(a) == normalize_url(b)


def _normalized(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_url)


def normalized(url: Column) -> Column:
    """Column form of :func:`normalize_url`; computed once, at ingest, and stored."""
    return F.pandas_udf(_normalized, StringType())(url)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_relative(url: Column) -> Column:
    return ~url.rlike("^(https?:)?//")


def same_url_column(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
