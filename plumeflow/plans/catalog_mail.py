"""Registered queries, fourth part: a mail of each publisher's format for each document, read back to its items.

Each mail holds two items, made from columns, and what the format leaves out; the SQL states the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import publishers as pb
from .catalog import query
from .fixtures import Tables

LINE = "-" * 72
#: An item's fields in Spark and in SQL; {n} is its number within the mail.
TITLE, SQL_TITLE = "concat('Thing number {n} of ', source, ' in mail ', doc_id)", "'Thing number {n} of ' || source || ' in mail ' || doc_id"
BODY, SQL_BODY = "concat('It does what is described here, in ', lang, ' and well.')", "'It does what is described here, in ' || lang || ' and well.'"
LINK, SQL_LINK = "concat('https://e.example.com/', doc_id, '/{n}')", "'https://e.example.com/' || doc_id || '/{n}'"


def _filled(template: str) -> Column:
    """A mail: {t1} {b1} {l1} {t2} {b2} {l2} in a template stand for the fields of its items."""
    marks = {f"{{{k}{n}}}": F.expr(e.replace("{n}", str(n))) for n in (1, 2) for k, e in (("t", TITLE), ("b", BODY), ("l", LINK))}
    out = F.lit(template)
    for mark, value in marks.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def _read(t: Tables, sender: str, text: str = "", page: str | None = None, subject: str | None = None) -> DataFrame:
    html = _filled(page) if page is not None else F.lit(None).cast("string")
    mails = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.lit(sender).alias("sender"), F.lit(subject).cast("string").alias("subject"), _filled(text).alias("text"), html.alias("html"))
    return pb.items(mails).select("path", "pos", "title", "content", "link", "section")


def _items_sql(sections: tuple[str | None, str | None], prefix: str = "", body: bool = True) -> str:
    def one(n: int, section: str | None) -> str:
        title = SQL_TITLE.replace("{n}", str(n))
        said = f"'{prefix}' || {SQL_BODY}" if body else title
        named = f"'{section}'" if section else "NULL::VARCHAR"
        return f"SELECT doc_id::VARCHAR AS path, {n - 1}::BIGINT AS pos, {title} AS title, {said} AS content, {SQL_LINK.replace('{n}', str(n))} AS link, {named} AS section FROM documents"

    return " UNION ALL ".join(one(n, s) for n, s in enumerate(sections, 1))


@query("par01_starred_sections", _items_sql(("ARTICLES", "ARTICLES")))
def par01(t):
    return _read(t, "JavaScript Weekly <jsw@peterc.org>", "Hello\nARTICLES\n* {t1}\n({l1})\n{b1}\n-----\n* {t2}\n( {l2} )\n{b2}\n-----\n* A SPONSORED thing to buy\n(https://s.example.com)\nSPONSORED text\n")


@query("par03_named_sections", _items_sql(("Articles", "Videos")))
def par03(t):
    return _read(t, "info@kotlinweekly.net", "Articles\n{t1} ({l1})\n{b1}\n\nVideos\n{t2} ({l2})\n{b2}\nSponsored\nA thing to buy (https://s.example.com)\ntext\nContribute\nWrite to us (https://w.example.com)\n")


@query("par04_dashed_pairs", _items_sql((None, None)))
def par04(t):
    return _read(t, "GeekNews <news@hada.io>", f"intro\n{LINE}\n{{t1}} * {{l1}}\n{LINE}\n{{b1}}\n{LINE}\n{{t2}} * {{l2}}\n{LINE}\n{{b2}}\n✓ 사내 커뮤니케이션 도구\nfooter")


@query("par05_enrichment_pages", f"SELECT doc_id::VARCHAR AS path, 0::BIGINT AS pos, {SQL_TITLE.replace('{n}', '1')} AS title, text AS content, {SQL_LINK.replace('{n}', '1')} AS link, 'Maeil Mail' AS section FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND doc_id % 3 <> 0".replace("text AS content", "trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content"))
def par05(t):
    def page(link: Column, content: Column, status: Column) -> Column:
        return F.struct(link.alias("url"), F.lit(None).cast("string").alias("normalized_url"), F.concat(F.lit("[매일메일] "), _filled("{t1}")).alias("title"), content.alias("content"), status.alias("status"))

    status = F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("success")
    pages = F.array(page(_filled("{l1}"), F.col("text"), status), page(F.concat(_filled("{l1}"), F.lit("#again")), F.lit("twice"), status), page(_filled("{l2}"), F.lit(" "), status))
    none = F.lit(None).cast("string")
    mails = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.lit("noreply@maeil-mail.kr").alias("sender"), none.alias("subject"), none.alias("text"), none.alias("html"), pages.alias("enrichment"))
    return pb.items(mails).select("path", "pos", "title", "content", "link", "section")


@query("par07_footnoted_titles", _items_sql(("HEADLINES", "TOOLS & CODE")))
def par07(t):
    return _read(t, "TLDR <dan@tldrnewsletter.com>", "HEADLINES\n{t1} [1]\n{b1}\nTOOLS & CODE\n{t2} [2]\n{b2}\nToo short a text follows this one [3]\nshort\n[1] {l1}\n[2] {l2}\n[3] https://x.example.com\n")


LINKS = "<p><a href='{l1}'>{t1}</a> <a href='{l1}#top'>{t1}</a><a href='{l2}'>{t2}</a><a href='{l2}/unsubscribe'>Unsubscribe here</a></p>"


@query("par08_html_links", _items_sql(("Article", "Article"), body=False).replace("e.example.com", "www.baeldung.com"))
def par08(t):
    return _linked(t, "Eugen <eugen@baeldung.com>", "www.baeldung.com")


def _linked(t: Tables, sender: str, host: str, subject: str | None = None) -> DataFrame:
    page = F.replace(_filled(LINKS), F.lit("e.example.com"), F.lit(host))
    mails = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.lit(sender).alias("sender"), F.lit(subject).cast("string").alias("subject"), F.lit("").alias("text"), page.alias("html"))
    return pb.items(mails).select("path", "pos", "title", "content", "link", "section")


@query("par09_magazine_links", _items_sql(("Article", "Article"), body=False).replace("e.example.com", "yozm.wishket.com/magazine/detail"))
def par09(t):
    return _linked(t, "yozm_help@wishket.com", "yozm.wishket.com/magazine/detail")


@query("par13_numbered_links", _items_sql(("VS CODE TOOLS", "BEST OF THE REST")))
def par13(t):
    return _read(t, "submissions@vscode.email", "VS CODE TOOLS\n{t1} [1] — {b1}\nBEST OF THE REST\n{t2} [2] — {b2}\nNOT TAKEN AT ALL\nA thing of another section [2] — with a text that is long enough.\nLinks:\n[1] {l1}\n[2] {l2}\n")


@query("par16_blocks", _items_sql((None, None)))
def par16(t):
    return _read(t, "node@cooperpress.com", "News\n* {t1}\n( {l1} )\n{b1}\n-----\n* {t2}\n{l2}\n{b2}\nIN BRIEF:\ntail without items\n")


@query("par17_markdown_blocks", _items_sql(("Articles", "Tools"), "Issue #700: "))
def par17(t):
    return _read(t, "rahul@pythonweekly.com", "Python Weekly - Issue 700\n##### **Articles**\n###### [{t1}]({l1})\n{b1}\n##### Tools\n###### [{t2}]({l2})\n{b2}\n###### [Short one](https://x.example.com)\nno\n")


@query("par18_android_cards", _items_sql(("Article", "Article"), body=False))
def par18(t):
    return _linked(t, "contact@androidweekly.net", "e.example.com", "Android Weekly #600")


@query("par20_sections", _items_sql(("Articles", "Tools")))
def par20(t):
    return _read(t, "css-weekly@beehiiv.com", "# Articles\n## [{t1} ✨]({l1})\n{b1}\n# Tools\n## [{t2}]({l2})\n{b2}\n")


@query("par14_single_article", f"SELECT doc_id::VARCHAR AS path, 0::BIGINT AS pos, 'A subject' AS title, {SQL_TITLE.replace('{n}', '1')} || chr(10) || {SQL_BODY} AS content, {SQL_LINK.replace('{n}', '1')} AS link, 'Substack' AS section FROM documents")
def par14(t):
    return _read(t, "someone@substack.com", "{t1}\n\n{b1}\n", page="<a href='https://x.example.com/unsubscribe'>x</a><a href='{l1}'>View</a>", subject="A subject")


@query("par22_cards", " UNION ALL ".join(f"SELECT doc_id::VARCHAR AS path, {n - 1}::BIGINT AS pos, {SQL_TITLE.replace('{n}', str(n))} AS title, '무슨 일인데? ' || {SQL_BODY} AS content, {SQL_LINK.replace('{n}', str(n))} AS link, '일분톡' AS section FROM documents" for n in (1, 2)))
def par22(t):
    card = "<div><table class='stb-one-col' style='background:#ffffff;'><tr><td><h3 style='text-align: center;'><span style='font-size: 26px;'>{t}</span></h3><a href='{l}'>x</a></td></tr></table><table><tbody><tr><td>무슨 일인데? {b}</td></tr></tbody></table></div>"
    cards = [card.replace("{t}", f"{{t{n}}}").replace("{l}", f"{{l{n}}}").replace("{b}", f"{{b{n}}}") for n in (1, 2, 1)]
    return _read(t, "news@ilbuntok.com", page="".join(cards))
