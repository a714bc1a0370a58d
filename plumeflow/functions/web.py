"""URLs and HTML pages. Pages are read by one small tree builder over the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is no article, and what a URL loses.
NO_ARTICLE_HOSTS = ("apps.apple.com", "github.com", "linkedin.com", "reddit.com", "twitter.com", "x.com", "youtu.be", "youtube.com")
NO_ARTICLE_SEGMENTS = ("preference", "preferences", "privacy", "setting", "unsubscribe")
NO_HTML_ENDS = ("gif", "gz", "jpeg", "jpg", "mov", "mp4", "pdf", "png", "svg", "tar", "tgz", "webp", "zip")
TRACKERS = ("fbclid", "gclid", "mc_cid", "mc_eid")
EDGE_MARKS = ".,;:!?)>]}'\""
SKIPPED_TAGS = ("script", "style", "noscript", "svg", "canvas", "iframe", "nav", "footer", "header", "aside", "form")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def is_no_article(url: Column) -> Column:
    """FLT16: a blocked host or its subdomain, a blocked path segment, or the end of a file that is no page."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    hosts = "|".join(h.replace(".", r"\.") for h in NO_ARTICLE_HOSTS)
    return F.rlike(host, F.lit(rf"(^|\.)({hosts})$")) | F.rlike(path, F.lit(rf"(^|/)({'|'.join(NO_ARTICLE_SEGMENTS)})(/|$)")) | F.rlike(path, F.lit(rf"\.({'|'.join(NO_HTML_ENDS)})$"))


def host_of(url: Column) -> Column:
    """URL03: host without 'www.'."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def rss_sender(link: Column, feed: Column) -> Column:
    """ING08: rss@domain of the item's link, else of its feed, else unknown.com; a domain has a dot."""
    a, b = host_of(link), host_of(feed)
    return F.concat(F.lit("rss@"), F.when(F.contains(a, F.lit(".")), a).when(F.contains(b, F.lit(".")), b).otherwise("unknown.com"))


def normal_url(url: str | None) -> str:
    """URL01: one form for equal addresses; '' for what is not http(s)."""
    try:
        u = urlsplit((url or "").strip().strip(EDGE_MARKS))
    except ValueError:
        return ""
    if u.scheme.lower() not in ("http", "https") or not u.netloc:
        return ""
    kept = sorted(p for p in parse_qsl(u.query, keep_blank_values=True) if not (p[0].lower() in TRACKERS or p[0].lower().startswith("utm_")))
    path = u.path.split(";")[0] if ";" in u.path.rsplit("/", 1)[-1] else u.path
    return urlunsplit((u.scheme.lower(), u.netloc.lower(), path.rstrip("/") or "/", urlencode(kept), ""))


def raw_normal_url(url: str | None) -> str:
    """URL02: the same over raw query strings, which stay as they are written and are sorted as strings; else the text before '#', without end slash."""
    text = (url or "").strip()
    try:
        u = urlsplit(text)
        if not u.scheme or not u.netloc:
            raise ValueError(text)
    except ValueError:
        return text.split("#")[0].rstrip("/")
    kept = sorted(q for q in u.query.split("&") if q and not (q.split("=")[0].lower() in TRACKERS or q.lower().startswith("utm_")))
    return urlunsplit((u.scheme.lower(), u.netloc.lower(), u.path.rstrip("/"), "&".join(kept), ""))


class Node:
    """An element, or the document itself (tag '')."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def all(self, *tags: str):
        """Elements below with one of the tags, in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                if not tags or n.tag in tags:
                    yield n
                stack.extend(reversed(n.children))

    def text(self, skip: tuple[str, ...] = ()) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skip:
                stack.extend(reversed(n.children))
        return " ".join(" ".join(out).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID_TAGS:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def links(page: str | None, base: str = "") -> list[tuple[str, str]]:
    """HTM01/ENR01: (address, text) of anchors, absolute, the first of each normal form."""
    seen, out = set(), []
    for a in tree(page).all("a"):
        href = a.attrs.get("href", "").strip()
        if href and not href.startswith(("data:", "javascript:", "mailto:", "#")):
            full = urljoin(base, href)
            key = normal_url(full)
            if key and key not in seen:
                seen.add(key)
                out.append((full, a.text()))
    return out


def article(page: str | None, least: int = 24) -> str | None:
    """ENR03: paragraphs of some length outside of page furniture, each once, in order."""
    found: dict[str, None] = {}
    stack = [tree(page)]
    while stack:
        n = stack.pop()
        if isinstance(n, str) or n.tag in SKIPPED_TAGS:
            continue
        if n.tag == "p":
            text = n.text(SKIPPED_TAGS)
            if len(text) >= least:
                found.setdefault(text)
        stack.extend(reversed(n.children))
    return "\n".join(found) or None


def page_image(page: str | None, base: str = "") -> str | None:
    """ENR04/EXT18: the page's image: by its meta fields in order, else the first image."""
    root = tree(page)
    metas = [(m.attrs.get("property"), m.attrs.get("name"), m.attrs.get("content", "")) for m in root.all("meta")]
    for kind, name in (("property", "og:image"), ("name", "twitter:image"), ("property", "twitter:image")):
        for prop, named, value in metas:
            if value and (prop if kind == "property" else named) == name:
                return urljoin(base, value.strip())
    src = next((i.attrs["src"] for i in root.all("img") if i.attrs.get("src")), None)
    return urljoin(base, src.strip()) if src else None


@F.pandas_udf(T.StringType())
def normal_url_udf(x: pd.Series) -> pd.Series:
    return x.map(normal_url)


@F.pandas_udf(T.StringType())
def raw_normal_url_udf(x: pd.Series) -> pd.Series:
    return x.map(raw_normal_url)


@F.pandas_udf(T.StringType())
def absolute_udf(base: pd.Series, link: pd.Series) -> pd.Series:
    """URL03: links made absolute."""
    return pd.Series([urljoin(b or "", x or "") for b, x in zip(base, link, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def article_udf(x: pd.Series) -> pd.Series:
    return x.map(article)


@F.pandas_udf(T.StringType())
def image_udf(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([page_image(p, b or "") for p, b in zip(page, base, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType().add("url", T.StringType()).add("text", T.StringType())))
def links_udf(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[{"url": u, "text": t} for u, t in links(p, b or "")] for p, b in zip(page, base, strict=True)], dtype=object)


def fetch_outcome(status: Column, kind: Column, content: Column, title_ok: Column, least: int = 700) -> Column:
    """ENR05/SRC12: outcome of a page, the first that applies."""
    return (
        F.when(status >= 400, F.concat(F.lit("http-"), status.cast("string")))
        .when(~F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("html")), "non-html")
        .when(F.length(F.coalesce(content, F.lit(""))) < least, "too-short")
        .when(~title_ok, "title-mismatch")
        .otherwise("success")
    )


def enriched(pages: DataFrame, status: Column | None = None, kind: Column | None = None, title_ok: Column | None = None) -> DataFrame:
    """ENR01-ENR06 over fetched pages (page_id, url, html, and what the fetch told of them): normal address, article, image, outcome.

    status, kind and title_ok are columns of pages; without them a page counts as an HTML page of status 200 that fits its title.
    """
    told = [(F.lit(200) if status is None else status).alias("_status"), (F.lit("text/html") if kind is None else kind).alias("_kind"), (F.lit(True) if title_ok is None else title_ok).alias("_ok")]
    rows = pages.select("page_id", "url", *told, normal_url_udf("url").alias("normal_url"), article_udf("html").alias("article"), image_udf("html", "url").alias("image"))
    return rows.withColumn("outcome", fetch_outcome(F.col("_status"), F.col("_kind"), F.col("article"), F.col("_ok"))).drop("_status", "_kind", "_ok")
