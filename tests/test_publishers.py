from pyspark.sql import functions as F

from plumeflow.sources import publishers as pb

TABLE = {p.name: p for p in pb.PUBLISHERS}


def titles(name, text="", subject=None, page=None):
    return [(r["title"], r["link"], r["section"]) for r in pb.parse(TABLE[name], subject, text, page)]


def test_markdown_sections():
    text = "Python Weekly - Issue 700\n##### **Articles**\n###### [A title of some length](https://e.com/a)\nA description that is long enough.\n###### [SPONSOR short thing](https://e.com/s)\nSPONSOR text that is long enough\n##### Tools\n###### [Another good title](https://e.com/b)\nIts description is fine too.\n"
    assert titles("Python Weekly", text) == [("A title of some length", "https://e.com/a", "Articles"), ("Another good title", "https://e.com/b", "Tools")]
    assert pb.parse(TABLE["Python Weekly"], None, text, None)[0]["content"] == "Issue #700: A description that is long enough."


def test_css_sections():
    text = "# Articles\n## [One ✨](https://e.com/1)\ntext one\n\nmore\n# Tools\n## [Two](https://e.com/22)\nx"
    assert titles("CSS Weekly", text.replace("One ", "One title ").replace("Two", "Two title")) == [("One title", "https://e.com/1", "Articles"), ("Two title", "https://e.com/22", "Tools")]


def test_starred_titles_with_url_below():
    text = "#500 — January 1, 2026\n* A title of good length\n( https://e.com/a )\nA description of more than twenty letters.\n* Sponsor message here\n(https://e.com/s)\nA description of more than twenty letters.\nIN BRIEF:\n* tail"
    assert titles("Cooperpress", text) == [("A title of good length", "https://e.com/a", None)]


def test_footnotes_and_libraries():
    text = "Issue #10 • January 1, 2026\nCSS & HTML TOOLS\nTool one [1] — Does a thing that is described well.\nTool two [2] — Does another thing, described as well.\nOTHER THINGS HERE\nTool three [3] — Not in a section that is taken at all.\nLinks:\n[1] https://e.com/1\n[2] https://e.com/2\n[3] https://e.com/3\n"
    rows = pb.parse(TABLE["Web Tools Weekly"], None, text, None)
    assert len(rows) == 1 and rows[0]["section"] == "Libraries" and "Tool two" in rows[0]["content"] and "three" not in rows[0]["content"]


def test_pairs_between_dashes():
    line = "-" * 72
    text = f"intro\n{line}\nFirst thing   * https://e.com/1\n{line}\nabout the  first\n{line}\nSecond thing * https://e.com/2\n{line}\nabout it\n✓ 사내 커뮤니케이션 도구 x"
    rows = pb.parse(TABLE["GeekNews"], None, text, None)
    assert [(r["title"], r["link"], r["content"]) for r in rows] == [("First thing", "https://e.com/1", "about the first"), ("Second thing", "https://e.com/2", "about it")]


def test_html_links():
    page = "<a href='https://yozm.wishket.com/magazine/detail/1/?utm_source=a'>A good title</a><a href='https://yozm.wishket.com/magazine/detail/1/'>A good title</a><a href='https://yozm.wishket.com/other'>Other one</a>"
    assert titles("Yozm", page=page) == [("A good title", "https://yozm.wishket.com/magazine/detail/1/?utm_source=a", "Article")]


def test_dispatch(spark):
    rows = [("a", "News <REACT@cooperpress.com>"), ("b", "node@cooperpress.com"), ("c", "x@y.z"), ("d", None)]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k string, s string").select("k", pb.publisher(F.col("s")).alias("p")).collect()}
    assert got == {"a": "React Status", "b": "Cooperpress", "c": None, "d": None}
    mails = spark.createDataFrame([("m", "css-weekly@beehiiv.com", "s", "# A\n## [A title](https://e.com/1)\nbody", None), ("n", "x@y.z", "s", "t", None)], "path string, sender string, subject string, text string, html string")
    assert [(r.publisher, r.title, r.content) for r in pb.items(mails).collect()] == [("CSS Weekly", "A title", "body")]


def test_cards():
    def card(title, link="", after="<table><tbody><tr><td>무슨 일인데? 본문</td></tr></tbody></table>"):
        return f"<div><table class='a stb-one-col' style='background:#ffffff;'><tr><td><h3 style='text-align: center;'><span style='font-size: 26px;'>{title}</span></h3>{link}</td></tr></table>{after}</div>"

    steps = "<div><p>앞</p><p>무슨 일인데?</p><p>하나</p><h3>둘</h3></div>"
    page = card("첫 <b>번</b>째 소식", "<a href='https://e.com/1'>x</a>") + card("두 번째 소식", after=steps) + card("첫 번째 소식") + card("오늘의 한 줄") + card("짧은") + card("세 번째 소식", after="<div><p>세 번째 소식</p><p>글</p></div>") + card("네 번째 소식", after="")
    rows = pb.parse(TABLE["Ilbuntok"], "subject", "text", page)
    assert [(r["title"], r["content"], r["link"]) for r in rows] == [
        ("첫 번째 소식", "무슨 일인데? 본문", "https://e.com/1"),
        ("두 번째 소식", "무슨 일인데?\n\n하나\n\n\n둘", "https://www.ilbuntok.com"),
        ("세 번째 소식", "글", "https://www.ilbuntok.com"),
        ("네 번째 소식", "네 번째 소식", "https://www.ilbuntok.com"),
    ]


def test_items_of_enrichment(spark):
    pages = [
        ("https://e.com/a?utm_source=m", None, "[매일메일]  A  title", " text a ", "SUCCESS"),
        ("https://e.com/a", None, "again", "text", "success"),
        ("https://e.com/b", "k", " ", "text b", "success"),
        ("https://e.com/c", "k", "same key", "text", "success"),
        ("https://e.com/d", None, "failed", "text", "failed"),
        ("https://e.com/e", None, "empty", " ", "success"),
    ]
    schema = "path string, sender string, subject string, text string, html string, enrichment array<struct<url string, normalized_url string, title string, content string, status string>>"
    mails = spark.createDataFrame([("m", "Maeil <noreply@maeil-mail.kr>", "[매일메일] Today", None, None, pages), ("n", "noreply@maeil-mail.kr", "s", "t", None, None)], schema)
    assert [(r.path, r.publisher, r.pos, r.title, r.content, r.link, r.section) for r in pb.items(mails).collect()] == [
        ("m", "Maeil Mail", 0, "A title", "text a", "https://e.com/a?utm_source=m", "Maeil Mail"),
        ("m", "Maeil Mail", 1, "Today", "text b", "https://e.com/b", "Maeil Mail"),
    ]
