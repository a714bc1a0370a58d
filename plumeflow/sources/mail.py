"""Mail files to rows."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, subject string, sender string, recipient string, received timestamp, content_type string, text string, html string, attachments array<struct<name:string,type:string,size:long>>, headers map<string,string>, error string"


def decode_mail(raw: bytes) -> dict:
    """SRC02/SRC03: one message: text parts and HTML parts joined by blank lines, attachments listed; a part that cannot be read is skipped."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    text, page, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        try:
            if part.get_filename() or part.get_content_disposition() == "attachment":
                files.append({"name": part.get_filename() or "", "type": part.get_content_type(), "size": len(part.get_payload(decode=True) or b"")})
            elif part.get_content_type() == "text/html":
                page.append(part.get_content())
            elif part.get_content_maintype() == "text":
                text.append(part.get_content())
        except (LookupError, UnicodeError, KeyError):
            continue
    date = m["date"].datetime if m["date"] is not None else None
    return {
        "subject": None if m["subject"] is None else str(m["subject"]),
        "sender": None if m["from"] is None else str(m["from"]),
        "recipient": None if m["to"] is None else str(m["to"]),
        "received": date,
        "content_type": m.get_content_type(),
        "text": "\n\n".join(text),
        "html": "\n\n".join(page) or None,
        "attachments": files,
        "headers": {k: str(v) for k, v in m.items()},
        "error": None,
    }


def read_mail(spark: SparkSession, folder: str) -> DataFrame:
    """SRC01-SRC03: all .eml files of a folder; a file that is no message gives a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    row = decode_mail(bytes(raw))
                except Exception as x:  # one broken file does not end the scan
                    row = {"error": f"{type(x).__name__}: {x}"}
                rows.append({"path": path, **row})
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.replace("struct<name:string,type:string,size:long>", "s").replace("map<string,string>", "m").split(", ")])
            out["received"] = pd.to_datetime(out["received"], utc=True)
            yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder).select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def accepted(mails: DataFrame, senders: list[str], known: DataFrame) -> DataFrame:
    """ING01: mails of supported senders that are not there yet by (sender, subject, received)."""
    low = F.lower(F.coalesce("sender", F.lit("")))
    ours = F.lit(False)
    for s in senders:
        ours = ours | F.contains(low, F.lit(s.lower()))
    keys = ["sender", "subject", "received"]
    return mails.where(ours).join(known.select(*keys).distinct(), keys, "left_anti")


def prompt(template: str, **values: str) -> str:
    """SRC14: a template with its {{PLACEHOLDERS}} filled."""
    for k, v in values.items():
        template = template.replace("{{" + k + "}}", v)
    return template
