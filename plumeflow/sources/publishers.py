"""Publisher documents to items: one line scanner driven by a table of publishers.

A publisher is a row of the table: who sends, how an item begins, how a
section does, where an item ends, what is left out, and how much is taken.
The scanner walks the lines once; HTML publishers are read by their links.
Dispatch takes the first publisher of the table that supports a sender.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web

# Marks of the publishers' formats.
LINK_LINE = r"\(?\s*(?P<url>https?://[^)\s]+)\s*\)?"
SPONSOR = r"\b(SPONSOR(ED)?|Sponsored)\b"
NEVER = ("advertise", "sponsor", "unsubscribe", "privacy policy", "web version", "view on web", "together with")
CARD_BEGIN = "무슨 일인데?"
NO_CARD = ("뭐가 궁금해?", "다음 소식들은", "일분톡 구독", "오늘의 한 줄", "더 많은 소식", "어제 소식", "이 기사 어때요?", "스크롤", "구독", "취소", "내 추천 포인트", "퀵뉴스님의 한 마디", "부린이를 위한 부동산")
INLINE = ("a", "abbr", "b", "code", "em", "font", "i", "img", "mark", "small", "span", "strong", "sub", "sup", "u")


@dataclass(frozen=True)
class Publisher:
    name: str
    senders: tuple[str, ...]
    item: str = ""  # a line that begins an item; groups title, url, note (footnote number) or text
    url_after: int = 0  # lines below the title within which the URL stands
    section: str = ""  # a line that begins a section; group 1 is its name
    only: frozenset[str] = frozenset()  # sections that are taken, if not all
    libraries: frozenset[str] = frozenset()  # sections whose items become one
    stop: str = ""  # a line that ends an item
    footer: str = ""  # what follows is not read
    issue: str = r"(?i)issue\s*#?(\d+)"
    title: int = 4
    text: tuple[int, int] = (0, 1000)
    most: int = 30
    host: str = ""  # HTML publishers: what a link must contain
    single: bool = False  # the whole document is one item
    subject: str = ""
    footnotes: bool = field(default=False)
    enriched: bool = False  # items are the pages of the mail's enrichment
    cards: bool = False  # HTML with one table for each item's head


PUBLISHERS = (
    Publisher("JavaScript Weekly", ("JavaScript Weekly", "jsw@peterc.org"), r"^\*\s+(?P<title>.+)$", 1, r"^([A-Z][A-Z ,&:+-]{3,})$", libraries=frozenset({"CODE & TOOLS", "CODE, TOOLS & LIBRARIES"}), stop=r"^-{5,}$", title=10, text=(0, 200)),
    Publisher("LibHunt", ("newsletter@libhunt.com",), r"^(\*\s+)?(?P<title>[^-]+?)\s+-\s+" + LINK_LINE + r"$|^(?P<title2>\S.{8,})$", 5, r"^(Popular News and Articles|Trending libraries and projects).*$", libraries=frozenset({"Trending libraries and projects"}), most=40),
    Publisher("Kotlin Weekly", ("Kotlin Weekly", "kotlinweekly.net"), r"^(?P<title>.+?)\s+\((?P<url>https?://[^)\s]+)\)$", 0, r"^(Announcements|Articles|Android|Multiplatform|Videos|Podcast|Conferences|Libraries|Contribute|Sponsored)$", only=frozenset({"Announcements", "Articles", "Android", "Multiplatform", "Videos", "Podcast", "Conferences", "Libraries"}), libraries=frozenset({"Libraries"})),
    Publisher("GeekNews", ("news@hada.io",), r"^(?P<title>.+?)\s+\*\s+(?P<url>https?://\S+)$", stop=r"^-{72}$", footer="✓ 사내 커뮤니케이션 도구"),
    Publisher("Maeil Mail", ("noreply@maeil-mail.kr",), enriched=True),
    Publisher("Korean FE Article", ("kofearticle@substack.com",), single=True, text=(0, 1500)),
    Publisher("TLDR", ("dan@tldrnewsletter.com",), r"^(?P<title>.+?)\s+\[(?P<note>\d+)\]$", 0, r"^([A-Z][A-Z &]{3,})$", text=(20, 1000), most=20, footnotes=True),
    Publisher("Baeldung", ("eugen@baeldung.com",), host="baeldung.com/", most=12),
    Publisher("Yozm", ("yozm_help@wishket.com",), host="yozm.wishket.com/magazine/detail/", most=12),
    Publisher("Bytes", ("tyler@ui.dev",), r"^(?P<title>\S.+)$", 0, stop=r"^\s*$"),
    Publisher(
        "Web Tools Weekly",
        ("submissions@webtoolsweekly.com",),
        r"^(?P<title>.+?)\s+(\[(?P<note>\d+)\]|" + LINK_LINE + r")\s+[—–-]\s*(?P<text>.*)$",
        0,
        r"^\**\s*([A-Z][A-Z ,&.()]{5,}?):?$",
        only=frozenset({"CSS & HTML TOOLS", "JAVASCRIPT UTILITIES", "TESTING & DEBUGGING TOOLS", "JAVASCRIPT LIBRARIES & FRAMEWORKS", "REACT TOOLS", "AI TOOLS, LLMS, ETC.", "MEDIA TOOLS (SVG, VIDEO, ETC.)", "THE UNCATEGORIZABLES"}),
        libraries=frozenset({"CSS & HTML TOOLS", "JAVASCRIPT UTILITIES", "TESTING & DEBUGGING TOOLS", "JAVASCRIPT LIBRARIES & FRAMEWORKS", "REACT TOOLS", "AI TOOLS, LLMS, ETC.", "MEDIA TOOLS (SVG, VIDEO, ETC.)", "THE UNCATEGORIZABLES"}),
        text=(20, 1000),
        footnotes=True,
        footer="\nLinks:\n",
    ),
    Publisher(
        "VS Code Email",
        ("submissions@vscode.email",),
        r"^(?P<title>.+?)\s+(\[(?P<note>\d+)\]|" + LINK_LINE + r")\s+[—–-]\s*(?P<text>.*)$",
        0,
        r"^\**\s*([A-Z][A-Z ,&.()]{5,}?):?$",
        only=frozenset({"VS CODE TOOLS", "VS CODE THEME OF THE WEEK", "VS CODE ARTICLES & VIDEOS", "BEST OF THE REST"}),
        text=(20, 1000),
        most=20,
        footnotes=True,
        footer="\nLinks:\n",
    ),
    Publisher("Substack", ("substack.com",), single=True, text=(0, 3000)),
    Publisher("React Status", ("React Status", "react@cooperpress.com"), r"^\*\s+(?P<title>.+)$", 1, r"^[🛠📙📢\s]*(Code, Tools.*|Elsewhere.*|In Brief:?)$", libraries=frozenset({"Code, Tools & Libraries"}), stop=r"^-{5,}$", title=10),
    Publisher("Cooperpress", ("frontend@cooperpress.com", "node@cooperpress.com", "postgres@cooperpress.com", "peter@golangweekly.com"), r"^\*\s+(?P<title>.+)$", 2, stop=r"(?i)^(⚡️\s*)?IN BRIEF:?$|^\s*[📙🛠📢].*$|^-{5,}$|^(JOBS|CODE, TOOLS|TOOLS|ELSEWHERE)", issue=r"#\s*(\d+)\s+—", title=10, text=(20, 1200), most=20),
    Publisher("Python Weekly", ("rahul@pythonweekly.com",), r"^######\s+\[(?P<title>[^]]+)\]\((?P<url>https?://[^)]+)\)", 0, r"^#####\s+\**(.+?)\**$", issue=r"(?i)Python Weekly\s*-\s*Issue\s*(\d+)", title=8, text=(15, 1000), most=20),
    Publisher("Android Weekly", ("contact@androidweekly.net",), host="http", subject="Android Weekly", most=20),
    Publisher("ITWorld", ("itworld@techlibrary.co.kr",), host="url=", most=12),
    Publisher("CSS Weekly", ("CSS Weekly", "css-weekly@beehiiv.com"), r"^## \[(?P<title>.*?)\]\((?P<url>https?://[^)]+)\)", 0, r"^# (.+)$"),
    Publisher("Swift with Vincent", ("Swift with Vincent", "swiftwithvincent.com"), single=True, text=(0, 3000)),
    Publisher("Ilbuntok", ("ilbuntok", "ilbuntok.com"), cards=True, title=5),
)


def publisher(sender: Column) -> Column:
    """UDX01: the name of the first publisher that supports the sender."""
    low = F.lower(F.coalesce(sender, F.lit("")))
    out = F.lit(None).cast("string")
    for p in reversed(PUBLISHERS):
        ours = F.lit(False)
        for s in p.senders:
            ours = ours | F.contains(low, F.lit(s.lower()))
        out = F.when(ours, p.name).otherwise(out)
    return out


def _plain(text: str) -> str:
    return " ".join(html.unescape(text).replace(" ", " ").split())


def _tidy(text: str | None) -> str:
    for a, b in (("\r\n", "\n"), ("\r", "\n"), (" ", " "), ("​", ""), ("­", "")):
        text = (text or "").replace(a, b)
    return text


def _scan(p: Publisher, text: str) -> list[dict]:
    """Items of a text, in order, with section and lines below the title."""
    notes = dict(re.findall(r"(?m)^\[(\d+)\]\s+(https?://\S+)\s*$", text)) if p.footnotes else {}
    if p.footer and p.footer in text:
        text = text[: text.index(p.footer)]
    lines = text.split("\n")
    items, section, at, below = [], None, None, 0
    for i, raw in enumerate(lines):
        line = raw.strip()
        head = re.match(p.section, line) if p.section else None
        start = None if head else re.match(p.item, line)
        if head:
            section, at = _plain(head[1]), None
        elif start and not (at is not None and below < p.url_after and not at["link"]):
            g = start.groupdict()
            link = (g.get("url") or notes.get(g.get("note") or "") or "").rstrip(").,]")
            at, below = {"title": _plain(g.get("title") or g.get("title2") or ""), "link": link, "section": section, "lines": [g["text"]] if g.get("text") else []}, 0
            items.append(at)
        elif p.stop and re.match(p.stop, line):
            if p.stop != r"^-{72}$" or at and at["lines"]:
                at = None
        elif at is not None:
            below += 1
            url = re.fullmatch(LINK_LINE, line) if not at["link"] and below <= p.url_after else None
            if url:
                at["link"] = url["url"]
            elif line and not line.startswith("--") and not (p.footnotes and re.fullmatch(r"\[\d+\]\s+https?://\S+", line)):
                at["lines"].append(line)
    return items


def _pages(enrichment: list[dict], subject: str | None) -> list[dict]:
    """PAR05: the pages that were read (url, normalized_url, title, content, status), the first of each address; of these, those with a content."""
    first: dict[str, dict] = {}
    for x in enrichment:
        url = (x["url"] or "").strip()
        if (x["status"] or "").lower() == "success" and url:
            first.setdefault((x["normalized_url"] or "").strip() or web.raw_normal_url(url), x)
    rows = []
    for x in first.values():
        if (x["content"] or "").strip():
            names = (" ".join(re.sub(r"^\s*\[매일메일\]\s*", "", t or "").split()) for t in (x["title"], subject, x["url"]))
            rows.append({"title": next((t for t in names if t), "Untitled"), "content": x["content"].strip(), "link": x["url"].strip(), "section": "Maeil Mail"})
    return rows


def _said(node: web.Node | str) -> str:
    """An element's text, words being parted by blanks and by blocks, not by inline elements."""

    def walk(n) -> Iterator[str]:
        if isinstance(n, str):
            yield n
            return
        block = n.tag not in INLINE
        yield " " if block else ""
        for c in n.children:
            yield from walk(c)
        yield " " if block else ""

    return " ".join("".join(walk(node)).split())


def _styled(node: web.Node, what: str) -> bool:
    return what in node.attrs.get("style", "").lower()


def _card_body(below: web.Node, title: str) -> str:
    """What follows the mark of the story's begin in the table below a card's head; without a mark, all paragraphs."""
    parts = [c for c in below.children if isinstance(c, web.Node)]
    if below.tag == "table" and any(c.tag == "tr" for c in parts):
        parts = [below]  # rows that no tbody encloses are one
    said = [(c, t) for c in parts if (t := _said(c))]
    begin = next((i for i, (_, t) in enumerate(said) if CARD_BEGIN in t), None)
    if begin is None:
        return "\n\n".join(t for x in below.all("p") if (t := _said(x)) and title not in t)
    out = said[begin][1] + "\n\n"
    for c, t in said[begin + 1 :]:
        out += ("\n" if c.tag in ("h3", "h4", "strong") or any(c.all("strong")) else "") + t + "\n\n"
    return out.strip()


def _cards(page: str | None) -> list[dict]:
    """PAR22: one row for each white table with a large centred title, distinct by title."""
    rows: dict[str, dict] = {}
    for table in web.tree(page).all("table"):
        if "stb-one-col" not in table.attrs.get("class", "").lower().split() or not _styled(table, "background:#ffffff"):
            continue
        heads = (s for x in table.all("p", "h3") if _styled(x, "text-align: center") for s in x.all("span") if _styled(s, "font-size: 26px"))
        head = next(heads, None)
        title = _said(head) if head else ""
        if len(title) < 5 or any(x in title for x in NO_CARD):
            continue
        around = [c for c in table.parent.children if isinstance(c, web.Node)]
        after = next(iter(around[next(i for i, c in enumerate(around) if c is table) + 1 :]), None)
        if after is not None:
            body = _card_body(after, title)
        else:
            body = "\n".join(_said(x) for x in table.all("p") if not _styled(x, "text-align: center"))
        links = (a.attrs["href"] for a in table.all("a") if "href" in a.attrs and not any(x in _said(a) for x in ("일분톡 구독", "이 기사 공유하기")))
        rows.setdefault(title, {"title": title, "content": body if body.strip() else title, "link": next(links, "https://www.ilbuntok.com"), "section": "일분톡"})
    return list(rows.values())


def parse(p: Publisher, subject: str | None, text: str | None, page: str | None, enrichment: list[dict] | None = None) -> list[dict]:
    """PAR01-PAR22: rows (title, content, link, section) of one document."""
    if p.enriched:
        return _pages(enrichment or [], subject)
    if p.cards:
        return _cards(page)
    text = _tidy(text)
    if p.subject and p.subject.lower() not in (subject or "").lower():
        return []
    if p.single:
        first = next((x.strip() for x in text.split("\n") if x.strip()), "")
        found = web.links(page) if page else [(u, "") for u in re.findall(r"https?://[^\s)>\]]+", text)]
        link = next((u for u, t in found if "unsubscribe" not in u.lower()), "")
        body = "\n".join(_plain(x) for x in text.split("\n") if x.strip())[: p.text[1]]
        return [{"title": _plain(subject or first), "content": body, "link": link, "section": p.name}] if first or subject else []
    if p.host:
        rows, seen = [], set()
        for url, title in web.links(page or ""):
            key = url.split("?")[0].split("#")[0]
            if p.host in url and key not in seen and len(title) >= p.title and not any(w in title.lower() for w in NEVER):
                seen.add(key)
                rows.append({"title": title, "content": title, "link": url, "section": "Article"})
        return rows[: p.most]
    issue = re.search(p.issue, text)
    prefix = f"Issue #{issue[1]}: " if issue else ""
    rows, seen = [], set()
    for x in _scan(p, text):
        body = _plain(" ".join(x["lines"]))[: p.text[1]]
        key = f"{x['section']}:{x['title']}".lower()
        said = f"{x['title']} {body}"
        if p.only and x["section"] not in p.only or key in seen or not x["link"] or len(x["title"]) < p.title or len(body) < p.text[0]:
            continue
        if re.search(SPONSOR, said) or any(w in x["title"].lower() for w in NEVER):
            continue
        seen.add(key)
        rows.append({"title": x["title"].removesuffix("✨").strip(), "content": f"{prefix}{body}" or x["title"], "link": x["link"], "section": x["section"]})
    return _grouped(p, rows[: p.most], issue[1] if issue else None)


def _grouped(p: Publisher, rows: list[dict], issue: str | None) -> list[dict]:
    """DIG09: the items of library sections become one, at the first one's place."""
    libs = [r for r in rows if r["section"] in p.libraries]
    if not libs:
        return rows
    link = next((r["link"] for r in libs if issue and f"/{issue}" in r["link"]), libs[0]["link"])
    name = f"{p.name} #{issue} libraries" if issue else f"{p.name} libraries"
    one = {"title": name, "content": "\n\n".join(f"{i}. {r['title']}\n{r['content']}\n{r['link']}" for i, r in enumerate(libs, 1)), "link": link, "section": "Libraries"}
    out = [r if r not in libs else one for r in rows if r not in libs or r is libs[0]]
    return out


def items(mails: DataFrame) -> DataFrame:
    """Rows (path, publisher, pos, title, content, link, section) of mails (path, sender, subject, text, html) from known publishers.

    A column ``enrichment`` has the pages read for a mail, an array of (url, normalized_url, title, content, status); without it there are none.
    """
    table = {p.name: p for p in PUBLISHERS}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (m.path, m.publisher, i, r["title"], r["content"], r["link"], r["section"])
                for m in pdf.itertuples()
                for i, r in enumerate(parse(table[m.publisher], m.subject, m.text, m.html, json.loads(m.enrichment) if m.enrichment else None))
            ]
            yield pd.DataFrame(rows, columns=["path", "publisher", "pos", "title", "content", "link", "section"])

    fields = ("url", "normalized_url", "title", "content", "status")
    pages = F.to_json(F.transform("enrichment", lambda x: F.struct(*(x[k].cast("string").alias(k) for k in fields))), {"ignoreNullFields": "false"}) if "enrichment" in mails.columns else F.lit(None).cast("string")
    known = mails.select("path", publisher(F.col("sender")).alias("publisher"), "subject", "text", "html", pages.alias("enrichment")).where("publisher is not null")
    return known.mapInPandas(run, "path string, publisher string, pos long, title string, content string, link string, section string")
