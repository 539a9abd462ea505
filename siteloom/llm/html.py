"""Main-text extraction by a recurrent block labeller (operator 5)."""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, with_fields

PATH, WORDS, EXTRA = 40, 24, 6
FEATURES = PATH + WORDS + EXTRA

#: Elements that begin a block of their own, that never hold others, and whose content is no text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|iframe"
#: Elements that hold others and no text of the page; tags that end an svg that was left open, as in
#: HTML, and the elements of an svg inside which they do not.
DROPPED = frozenset("svg object template noscript".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INSIDE = frozenset("foreignobject desc title".split())
#: What an opening tag closes, as HTML lets authors leave out end tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
NO_PARAGRAPH = BLOCKS - {"body", "head", "html", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption", "legend", "button", "select"}

#: Every part takes what it can and gives nothing back, and ends at the end of the page if not before: no character is
#: read again for each tag that is left open.
TAGS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<open>[^>]*+)(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?P<shut>>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
HAS_DROPPED = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})[\s/>]", re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


@lru_cache(4096)
def marks(tag: str, attrs: str) -> tuple[str, ...]:
    """What a path knows of an element: its tag, and the letters of its class, id and role."""
    found = [tag]
    for _, value in NAMED.findall(attrs):
        found += ["." + w.lower() for w in re.findall(r"[A-Za-z]{2,}", re.sub(r"([a-z])([A-Z])", r"\1 \2", value))]
    return tuple(found)


class Place:
    """Where a block stands: its element and what holds it. The vector of a place is its own marks and, at four
    fifths, its parent's: signed hashing in which nearer marks weigh more, and the nearest count apart."""

    __slots__ = ("parent", "found", "made")

    def __init__(self, parent: Place | None, found: tuple[str, ...]):
        self.parent, self.found, self.made = parent, found, None

    def vector(self) -> np.ndarray:
        todo, place = [], self
        while place is not None and place.made is None:
            todo.append(place)
            place = place.parent
        for place in reversed(todo):
            own = mark_vector(place.found)
            place.made = own if place.parent is None else own + np.float32(0.8) * place.parent.made
        return self.made


@lru_cache(65536)
def mark_vector(found: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for mark in found:
        for told in (mark, "#" + mark):
            h = zlib.crc32(told.encode("utf-8", "surrogatepass"))
            v[h % PATH] += 1.0 if h & 0x10000 else -1.0
    return v


def tokens(page: str) -> list[tuple[int, int, re.Match | None]]:
    """(start, end, tag if it is one) of all that is no text, in page order. A tag that the page leaves open is text.

    An element of ``DROPPED`` is one token if its end is there: its end tag, '/>' of an svg, or what ends an svg in
    HTML. One that is left open is a tag like others, and hides nothing."""
    if not HAS_DROPPED.search(page):
        return [(m.start(), m.end(), m if m["tag"] else None) for m in TAGS.finditer(page) if m["shut"] != ""]
    out: list[tuple[int, int, re.Match | None]] = []
    opened: list[tuple[str, int]] = []
    among: Counter[str] = Counter()
    at = 0
    while m := TAGS.search(page, at):
        if m["shut"] == "":
            break
        at = m.end()
        in_svg = bool(opened) and opened[-1][0] == "svg"
        if m["raw"] and in_svg and m["open"].endswith("/"):
            at = m.end("open") + 1
        tag = (m["tag"] or "").lower()
        if tag in BREAKS and in_svg and not m["end"]:
            while opened and opened[-1][0] == "svg":
                name, first = opened.pop()
                among[name] -= 1
            out[first:] = [(out[first][0], m.start(), None)]
        out.append((m.start(), at, m if tag else None))
        if tag not in DROPPED and tag not in INSIDE:
            continue
        if not m["end"]:
            closed = m["attrs"].endswith("/")
            if tag in DROPPED and not (closed and (tag == "svg" or in_svg)) or tag in INSIDE and in_svg and not closed:
                opened.append((tag, len(out) - 1))
                among[tag] += 1
        elif among[tag]:
            name = ""
            while name != tag:
                name, first = opened.pop()
                among[name] -= 1
            if tag in DROPPED:
                out[first:] = [(out[first][0], at, None)]
    return out


def leaves(page: str) -> list[tuple[Place | None, str, int]]:
    """(place, text, letters inside links) of every block that holds text, in page order.

    Inline elements join their block; comments, scripts, styles and other raw content are no text,
    nor is what svg, object, template and noscript hold between their tags.
    References are decoded after the tags are found, and white space becomes one space.
    The time is linear in the page, however many elements are open.
    """
    out: list = []
    names: list[str] = []
    path: list[Place] = []
    #: The depths at which each tag is open, the nearest last.
    depths: dict[str, list[int]] = {}
    held: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((path[-1] if path else None, text, linked))
            held.clear()
        linked = 0

    def close(upto: int) -> None:
        if any(n in BLOCKS for n in names[upto:]):
            flush()
        for n in names[upto:]:
            depths[n].pop()
        del names[upto:], path[upto:]

    def add(text: str) -> None:
        nonlocal linked
        held.append(text)
        linked += len(text) if depths.get("a") else 0

    for start, end, m in tokens(page):
        if start > at:
            add(page[at:start])
        at = end
        if m is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if depths.get(tag):
                close(depths[tag][-1])
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            add(" ")
        if tag in NO_PARAGRAPH and depths.get("p"):
            close(depths["p"][-1])
        if tag in CLOSES:
            # The innermost open element that this one ends, if no list or table has begun inside it.
            last = lambda tags: max((depths[t][-1] for t in tags if depths.get(t)), default=-1)
            if (k := last(CLOSES[tag])) >= max(0, last(("ul", "ol", "dl", "table", "select"))):
                close(k)
        if tag in BLOCKS:
            flush()
        if tag not in VOID and not m["attrs"].endswith("/"):
            depths.setdefault(tag, []).append(len(names))
            names.append(tag)
            path.append(Place(path[-1] if path else None, marks(tag, m["attrs"])))
    if at < len(page):
        add(page[at:])
    flush()
    return out


class WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return found


def vectors(blocks: list, buckets: WordBuckets) -> np.ndarray:
    """A row of features for each block: path, hashed words, length, links, signs and place."""
    x = np.zeros((len(blocks), FEATURES), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        words = text.split(" ")
        if path is not None:
            x[i, :PATH] = path.vector()
        x[i, PATH : PATH + WORDS] = np.bincount([buckets[w] for w in words], minlength=WORDS) / np.sqrt(len(words)) / 4
        x[i, -EXTRA:] = (np.log1p(len(words)) / 4, min(linked / len(text), 1), (text[-1] in ".!?…\"'") - 0.5, text.count(".") / len(words), i / len(blocks), 1 / (1 + i))
    return x


class BiLstm:
    """Two LSTMs, one in each direction, and a logistic layer over both states of a block."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        make = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.params = [p for _ in range(2) for p in (make(FEATURES, 4 * hidden), make(hidden, 4 * hidden), np.repeat(np.float32([0, 1, 0, 0]), hidden))]
        self.params += [make(2 * hidden, 1), np.zeros(1, np.float32)]

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits (pages, blocks) of padded features (pages, blocks, FEATURES)."""
        b, t, _ = x.shape
        h_all = np.zeros((b, t, 2 * self.hidden), np.float32)
        n = self.hidden
        for d in range(2):
            w, u, bias = self.params[3 * d : 3 * d + 3]
            z_in = x @ w + bias
            h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                z = z_in[:, k] + h @ u
                s = 1 / (1 + np.exp(-z[:, : 3 * n]))
                g = np.tanh(z[:, 3 * n :])
                m = mask[:, k, None]
                c_new = s[:, n : 2 * n] * c + s[:, :n] * g
                tc = np.tanh(c_new)
                if keep is not None:
                    keep.append((d, k, h, c, s, g, tc, m))
                h, c = m * (s[:, 2 * n :] * tc) + (1 - m) * h, m * c_new + (1 - m) * c
                h_all[:, k, d * n : (d + 1) * n] = h
        if keep is not None:
            keep.append(h_all)
        return (h_all @ self.params[6])[..., 0] + self.params[7]

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        keep: list = []
        logits = self.run(x, mask, keep)
        h_all = keep.pop()
        n = self.hidden
        d_logit = mask * (1 / (1 + np.exp(-logits)) - y) / mask.sum()
        grads = [np.zeros_like(p) for p in self.params]
        grads[6][:, 0] = np.einsum("bt,bth->h", d_logit, h_all)
        grads[7][0] = d_logit.sum()
        d_h_all = d_logit[..., None] * self.params[6][:, 0]
        dh = [np.zeros((len(x), n), np.float32) for _ in range(2)]
        dc = [np.zeros((len(x), n), np.float32) for _ in range(2)]
        for d, k, h, c, s, g, tc, m in reversed(keep):
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            up = dh[d] + d_h_all[:, k, d * n : (d + 1) * n]
            d_c = m * (up * o * (1 - tc * tc) + dc[d])
            d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), m * up * tc * o * (1 - o), d_c * i * (1 - g * g)], 1)
            grads[3 * d] += x[:, k].T @ d_z
            grads[3 * d + 1] += h.T @ d_z
            grads[3 * d + 2] += d_z.sum(0)
            dh[d] = d_z @ self.params[3 * d + 1].T + (1 - m) * up
            dc[d] = d_c * f + (1 - m) * dc[d]
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, FEATURES), np.float32), np.zeros((len(pages), t), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


#: Fixed values of the training pages: names that sites give to the parts around an article and to the article.
AROUND = {
    "nav": ("nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs toc pagination", "nav div ul"),
    "header": ("header site-header masthead banner top branding logo", "header div"),
    "footer": ("footer site-footer bottom copyright colophon legal", "footer div"),
    "aside": ("sidebar side aside widget related recommended popular trending teaser", "aside div section"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo banner-ad adsbygoogle", "div aside section ins"),
    "notice": ("cookie cookie-notice consent gdpr notice alert newsletter-popup modal overlay privacy-banner", "div section aside dialog"),
    "form": ("form search search-form login signup subscribe newsletter contact-form", "form div"),
    "comments": ("comments comment comment-list discussion responses replies disqus reader-comments", "div section ol"),
    "share": ("share social sharing follow tags byline-tools", "div ul"),
}
MAIN = ("article content post entry main story body-text article-body post-content entry-content text", "article main div section")


def training_page(rng: random.Random) -> tuple[str, str]:
    """A made page and its main text: an article among other parts, some of them without telling names."""
    syllables = "the an er on re th in at es or ti ed ou ea nd st ha ly sh de la que en ment aux ung ver sch ción os ar".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 1, 2, 2, 3, 4))))

    def words(n: int) -> str:
        junk = rng.random() < 0.1
        return " ".join(word() + (rng.choice(("***", "###", " |", "!!")) if junk else "") for _ in range(n))

    def sentence() -> str:
        return words(rng.randint(1, 25)).capitalize() + rng.choice("..........!?")

    text = lambda n: " ".join(sentence() for _ in range(n))
    main: list[str] = []

    def element(tag: str, names: str, inner: str) -> str:
        name = rng.choice(names.split())
        attr = rng.choice(('class="%s"', 'id="%s"', "class='x %s'", 'class="%s-wrap"', "", "")) if tag not in ("div", "section", "ul", "ol", "ins") else rng.choice(('class="%s"', 'id="%s"', 'class="c1 %s"', 'role="%s"'))
        attr = attr % name if "%s" in attr else attr
        return f"<{tag}{' ' if attr else ''}{attr}>{inner}</{tag}>"

    def part(kind: str) -> str:
        names, tags = AROUND[kind]
        tag = rng.choice(tags.split())
        link = lambda n: f'<a href="/{word()}">{words(n)}</a>'
        if kind in ("nav", "share") or kind == "aside" and rng.random() < 0.4:
            items = "".join(f"<li>{link(rng.randint(1, 4))}{rng.choice(('</li>', '</li>', ''))}" for _ in range(rng.randint(2, 9)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>" if rng.random() < 0.7 else "".join(link(1) + " " for _ in range(5))
        elif kind == "form":
            inner = f"<label>{words(2)}</label><input name=q><button>{words(1)}</button>" + (f"<p>{sentence()}</p>" if rng.random() < 0.5 else "")
        elif kind == "comments":
            inner = f"<h3>{words(2)}</h3>" + "".join(f'<{rng.choice(("li", "div"))} class="comment"><p>{text(rng.randint(1, 4))}</p>' for _ in range(rng.randint(1, 6)))
        elif kind == "footer":
            inner = rng.choice((f"&copy; {word()}.example.com &middot; {text(rng.randint(1, 2))}", f"<p>&copy; {words(6)}</p>", "".join(f"<p>{link(2)}</p>" for _ in range(4))))
        elif kind == "header":
            inner = rng.choice((link(2), f"<h2>{words(3)}</h2>", f"<h1><a href=/>{words(2)}</a></h1><p>{words(5)}</p>"))
        else:
            inner = rng.choice((text(rng.randint(1, 3)), f"<p>{text(rng.randint(1, 3))}</p>", f"<h4>{words(3)}</h4><p>{sentence()}</p>"))
        return element(tag, names, inner)

    def said(t: str) -> str:
        main.append(t)
        return t.replace("&", "&amp;")

    def article() -> str:
        title = words(rng.randint(2, 12)).capitalize()
        inner = f"<h1>{said(title)}</h1>" if rng.random() < 0.9 else ""
        if rng.random() < 0.3:
            inner += rng.choice(("<p><b>%s<br>", "<p class=lead>%s</p>")) % said(sentence())
        for _ in range(rng.choice((0, 1, 2, 4, 8, 12, 20, 30)) or 1):
            kind = rng.random()
            if kind < 0.75:
                inner += f"<p>{said(text(rng.randint(1, 9)))}" + rng.choice(("</p>", "</p>", "</p>", "<br>", ""))
            elif kind < 0.83:
                inner += f"<h{(k := rng.randint(2, 4))}>{said(words(rng.randint(1, 6)))}</h{k}>"
            elif kind < 0.88:
                inner += "<ul>" + "".join(f"<li>{said(words(rng.randint(2, 12)))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            elif kind < 0.92:
                inner += f"<blockquote><p>{said(sentence())}</p></blockquote>"
            elif kind < 0.96:
                inner += f"<p><b>{said(sentence())}<br>"
            else:
                inner += part(rng.choice(("ad", "aside", "share")))
        names, tags = MAIN
        return element(rng.choice(tags.split() + ["article"] * 4), names, inner)

    before = [part(k) for k in AROUND if k in ("nav", "header", "notice", "ad") and rng.random() < 0.55]
    after = [part(k) for k in AROUND if k not in ("nav", "header") and rng.random() < 0.35]
    rng.shuffle(before), rng.shuffle(after)
    body = "".join(before) + article() + "".join(after)
    if rng.random() < 0.3:
        body = f'<div id="{rng.choice(("page", "wrapper", "root", "container"))}">{body}</div>'
    page = f"<!DOCTYPE html><html><head><title>{words(5)}</title></head><body>{body}" + rng.choice(("</body></html>", ""))
    return page, " ".join(" ".join(main).split())


def training_set(pages: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, buckets, out = random.Random(seed), WordBuckets(), []
    for _ in range(pages):
        page, main = training_page(rng)
        blocks, at, y = leaves(page), 0, []
        for _, text, _ in blocks:
            # The main text's blocks are met in order; anything else is around it.
            if main.startswith(text, at):
                y.append(1.0)
                at += len(text) + 1
            else:
                y.append(0.0)
        out.append((vectors(blocks, buckets), np.array(y, np.float32)))
    return out


@lru_cache(2)
def trained(pages: int = 900, epochs: int = 14, seed: int = 11) -> BiLstm:
    """The labeller, trained on made pages: the same on every call."""
    data = sorted(training_set(pages, seed), key=lambda p: len(p[0]))
    model, rng = BiLstm(), np.random.default_rng(seed)
    batches = [data[i : i + 30] for i in range(0, len(data), 30)]
    m, v, step = [np.zeros_like(p) for p in model.params], [np.zeros_like(p) for p in model.params], 0
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask = padded([p for p, _ in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, labels) in enumerate(batches[k]):
                y[i, : len(labels)] = labels
            step += 1
            for j, g in enumerate(model.gradients(x, y, mask)):
                g = np.clip(g, -1, 1)
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                rate = 0.01 * (0.2 if epoch >= epochs - 4 else 1)
                model.params[j] = model.params[j] - (rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def label(model: BiLstm, pages: list[list], buckets: WordBuckets, cells: int = 60_000) -> list[np.ndarray]:
    """Which blocks of each page are main text. Pages of like length run together, at most ``cells`` blocks."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        n = len(order)
        while n > 1 and n * len(pages[order[n - 1]]) > cells:
            n = max(1, n // 2)
        group, order = order[:n], order[n:]
        x, mask = padded([vectors(pages[i], buckets) for i in group])
        for i, logit in zip(group, model.run(x, mask)):
            out[i] = logit[: len(pages[i])] > 0
    return out


def extract(pages: DataFrame, *, html: str = "html", model: BiLstm | None = None) -> DataFrame:
    """Adds ``text`` (the main text: blocks of the article joined by a space) and ``n_chars`` to every row, in
    place of ``html``; replaces columns so named. Null and empty pages, and pages without main text, give the
    empty string. Rows are independent: no shuffle, and repeated rows stay; an empty table gives no rows; pages have
    any length, and their time is linear in it."""
    small_batches(pages.sparkSession, 256)
    pages = pages.drop(*(c for c in ("text", "n_chars") if c != html))
    keep = [c for c in pages.columns if c != html]
    params = (model or trained()).params

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, buckets = BiLstm(), WordBuckets()
        run.params = params
        for b in batches:
            blocks = [leaves(p or "") for p in b.column(html).to_pylist()]
            texts = [" ".join(t for (_, t, _), good in zip(found, marked) if good) for found, marked in zip(blocks, label(run, blocks, buckets))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(extracted, with_fields(pages.select(*keep).schema, text="string", n_chars="long"))
