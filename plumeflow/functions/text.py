"""Text functions as column expressions; Python only where a codec has no built-in form."""

from __future__ import annotations

import base64
import email.header
import html
import quopri
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words without weight in titles, invisible code points, title keywords and their priority.
STOP_WORDS = ("about", "after", "into", "that", "this", "what", "when", "where", "which", "with", "your")
INVISIBLE = "​‌‍⁠﻿­"
#: Space separators of Unicode (Zs), which SQL's trim takes away; Spark's takes U+0020 only.
BLANKS = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def collapse(x: Column) -> Column:
    """STR01: blanks (NBSP included) to one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


def clean_lines(x: Column) -> Column:
    """STR02/STR03: line ends unified, each line collapsed, empty lines dropped."""
    lines = F.transform(F.split(F.regexp_replace(x, r"\r\n?", "\n"), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def before(x: Column, mark: str) -> Column:
    """STR04: what stands before the first mark; all of it if there is none."""
    return F.when(F.instr(x, mark) > 0, F.substring_index(x, mark, 1)).otherwise(x)


def after(x: Column, mark: str) -> Column:
    """STR04: what stands after the first mark; all of it if there is none."""
    at = F.instr(x, mark)
    return F.when(at > 0, F.substring(x, at + len(mark), F.length(x))).otherwise(x)


def without_ends(x: Column, prefix: str = "", suffix: str = "") -> Column:
    """STR04: prefix and suffix removed where they are."""
    x = F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)
    return F.when(F.endswith(x, F.lit(suffix)), F.substring(x, F.lit(1), F.length(x) - len(suffix))).otherwise(x)


def first_match(x: Column, pattern: str, group: int = 0) -> Column:
    """STR08: the first match of a pattern, null if there is none."""
    return F.when(F.rlike(x, F.lit(pattern)), F.regexp_extract(x, pattern, group))


def all_matches(x: Column, pattern: str, group: int = 0) -> Column:
    """STR08: all matches of a pattern, in order."""
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def split_at(x: Column, pattern: str, limit: int) -> Column:
    """STR08: at most ``limit`` parts, the last one with all the rest."""
    return F.split(x, pattern, limit)


def literal(text: str) -> str:
    """STR18: a pattern that matches the text itself."""
    return re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", text)


def seconds(x: Column) -> Column:
    """DAT04: a duration such as '90s', '15m', '2h', '1d' or '500ms' in seconds; a bare number counts as seconds, others are null."""
    x = F.lower(F.trim(x))
    number = F.regexp_extract(x, r"^([0-9]+(?:\.[0-9]+)?)\s*(ms|s|m|h|d)?$", 1).try_cast("double")
    unit = F.regexp_extract(x, r"^([0-9]+(?:\.[0-9]+)?)\s*(ms|s|m|h|d)?$", 2)
    return number * F.when(unit == "ms", 0.001).when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86_400.0).otherwise(1.0)


def zone_offset(x: Column) -> Column:
    """DAT04: minutes of a zone literal, 'Z', 'UTC', '+09:00', '+0900' or '-3'; others are null."""
    x = F.upper(F.trim(x))
    form = r"^(?:UTC|GMT)?([+-])([0-9]{1,2}):?([0-9]{2})?$"
    minutes = F.regexp_extract(x, form, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(x, form, 3).try_cast("int"), F.lit(0))
    return F.when(x.isin("Z", "UTC", "GMT"), 0).when(F.rlike(x, F.lit(form)), F.when(F.regexp_extract(x, form, 1) == "-", -minutes).otherwise(minutes))


def truncate(x: Column, n: int) -> Column:
    """STR05: n code points and '...' if there is more."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def contains_any(x: Column, *parts: str) -> Column:
    """STR06: case-insensitive containment of any part."""
    low = F.lower(x)
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(low, F.lit(p.lower()))
    return found


def remove_block(x: Column, start: str, *ends: str) -> Column:
    """STR07: the text without what lies from a start mark to the nearest end mark after it; unchanged if either is missing."""
    at = F.instr(x, start)
    tail = F.substring(x, at + len(start), F.length(x))
    stops = F.array(*(F.when(F.instr(tail, e) > 0, F.instr(tail, e)) for e in ends))
    near = F.array_min(stops)
    return F.when((at > 0) & near.isNotNull(), F.concat(F.substring(x, F.lit(1), at - 1), F.substring(tail, near, F.length(x)))).otherwise(x)


def limit_at_line(x: Column, n: int) -> Column:
    """ENR06: at most n code points, cut at the last line end within, and '...'."""
    # \z, since $ would also match before a line end that ends the head
    head = F.regexp_replace(F.substring(x, 1, n), r"\n[^\n]*\z", "")
    return F.when(F.length(x) > n, F.concat(F.trim(head, F.lit(BLANKS)), F.lit("..."))).otherwise(x)


def significant_terms(x: Column) -> Column:
    """STR17: distinct words of four letters and more in order, stop words aside."""
    words = F.split(F.regexp_replace(F.lower(x), r"[^0-9a-z가-힣]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS)))


def relevant(title: Column, content: Column) -> Column:
    """FLT18: two significant terms of the title (or all, if there are fewer) are in the content, or one that has a digit."""
    terms = significant_terms(title)
    low = F.lower(content)
    met = F.filter(terms, lambda w: F.contains(low, w))
    return (F.size(terms) == 0) | (F.size(met) >= F.least(F.lit(2), F.size(terms))) | F.exists(met, lambda w: F.rlike(w, F.lit("[0-9]")))


def title_priority(title: Column, table: tuple[tuple[str, int], ...], default: int = 50) -> Column:
    """ING07: priority of the first keyword that a title has."""
    out = F.lit(default)
    for words, value in reversed(table):
        out = F.when(F.rlike(F.lower(title), F.lit(words)), value).otherwise(out)
    return out


def language(x: Column) -> Column:
    """PRJ02: KOREAN for its names, else ENGLISH."""
    return F.when(F.lower(F.coalesce(x, F.lit(""))).isin("ko", "korean", "한국어"), "KOREAN").otherwise("ENGLISH")


def exposure_text(summary: Column, content: Column) -> Column:
    """ING05: the summary, else the first 500 code points of the content."""
    return F.coalesce(summary, truncate(content, 500))


def sender_address(x: Column) -> tuple[Column, Column]:
    """ING02: (name, address) of 'Name <address>'; without a name, the address."""
    has = F.rlike(x, F.lit(r"<[^>]+>"))
    address = F.when(has, F.trim(F.regexp_extract(x, r"<([^>]+)>", 1))).otherwise(F.trim(x))
    name = F.regexp_replace(F.trim(F.regexp_replace(x, r"<[^>]*>.*$", "")), '^"+|"+$', "")
    return F.when(has & (name != ""), name).otherwise(address), address


def unquote_printable(text: str | None) -> str | None:
    """STR09: quoted-printable to text; mixed non-ASCII characters stay."""
    if text is None or "=" not in text:
        return text
    return quopri.decodestring(text.encode()).decode("utf-8", "replace")


def mend_entities(text: str | None) -> str | None:
    """STR11: one blank, or a soft line break, inside an entity removed: '&n bsp;' and '&n= bsp;' to '&nbsp;'."""
    return None if text is None else re.sub(r"&(#?[0-9A-Za-z]+)=?[ \t]([0-9A-Za-z]+);", r"&\1\2;", text)


def sanitize(text: str | None) -> str | None:
    """STR13: quoted-printable, broken entities, entities, invisible characters, in this order."""
    if text is None:
        return None
    out = html.unescape(mend_entities(unquote_printable(text)))
    return out.translate({ord(c): None for c in INVISIBLE}).replace(" ", " ")


def guarded_base64(text: str | None) -> str | None:
    """STR14: base64 to text, null if it is none."""
    try:
        return None if text is None else base64.b64decode(text, validate=True).decode()
    except ValueError:
        return None


def decoded_header(text: str | None) -> str | None:
    """ING02: RFC 2047 words of a header decoded."""
    return None if text is None else str(email.header.make_header(email.header.decode_header(text)))


def declared_charset(content_type: Column) -> Column:
    """CHR01: the charset that a content type names, in lower case; null if it names none."""
    return F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", 1)), F.lit(""))


def decoded(raw: bytes | None, charset: str | None) -> str | None:
    """CHR01: bytes as text by their charset, else as UTF-8; what cannot be read is replaced."""
    if raw is None:
        return None
    try:
        return bytes(raw).decode(charset or "utf-8", "replace")
    except LookupError:
        return bytes(raw).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decoded_udf(raw: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([decoded(r, c) for r, c in zip(raw, charset, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def sanitize_udf(x: pd.Series) -> pd.Series:
    return x.map(sanitize, na_action="ignore")


@F.pandas_udf(T.StringType())
def header_udf(x: pd.Series) -> pd.Series:
    return x.map(decoded_header, na_action="ignore")
