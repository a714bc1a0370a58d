"""Web-server logs: parsing, classes, path patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line formats and the patterns of the classes.
ACCESS = (
    r'^(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]+)" ([0-9]{3}) ([0-9]+) "([^"]*)" "([^"]*)" "([^"]*)" '
    r'rt=([-0-9.]+) uct="([^"]*)" uht="([^"]*)" urt="([^"]*)"'
)
ACCESS_FIELDS = ["ip", "user", "ts_text", "method", "target", "protocol", "status", "bytes", "referer", "user_agent", "xff", "rt", "uct", "uht", "urt"]
ERROR = r"^([0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) \[(\w+)\] (.*)$"
BAD_TARGET = (
    r"(?i)(\.\./|%2e%2e|%252e%252e|pearcmd|php://|data://|expect://|<\?php|<\?echo|eval\(|base64_decode|/(index|xmlrpc)\.php(\?|$)|"
    r"(^|/)(\.env|\.git|sdk/|wp-|wordpress|phpmyadmin|boaform|config|admin|vendor|cgi-bin))"
)
BAD_AGENT = "(?i)(libredtail|sqlmap|nikto|acunetix|nessus|zgrab|masscan|nuclei|dirbuster|gobuster)"
UUID = "(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?=/|$)"


def first_number(x: Column) -> Column:
    """MTH03: the first of a comma-separated list as a number; '-', blank and others are null."""
    return F.trim(F.split(x, ",")[0]).try_cast("double")


def request_path(target: Column) -> Column:
    """URL04: the path of a request target, '/' if it has none."""
    path = F.split(F.regexp_replace(target, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "[?#]")[0]
    return F.when(path == "", F.lit("/")).otherwise(path)


def normal_path(target: Column) -> Column:
    """LOG06: UUID and number segments of the path replaced by their kinds."""
    return F.regexp_replace(F.regexp_replace(request_path(target), UUID, "/{uuid}"), "/[0-9]+(?=/|$)", "/{id}")


def parse_access(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """LOG01: lines (line_no, line) to fields; what does not match has parsed = false and null fields."""
    ok = F.rlike("line", F.lit(ACCESS))
    fields = {n: F.when(ok, F.regexp_extract("line", ACCESS, i + 1)) for i, n in enumerate(ACCESS_FIELDS)}
    rows = lines.select("line_no", ok.alias("parsed"), *(c.alias(n) for n, c in fields.items()))
    return rows.select(
        "line_no",
        "parsed",
        "ip",
        "method",
        "target",
        F.col("status").cast("int").alias("status"),
        F.col("bytes").cast("long").alias("bytes"),
        "user_agent",
        F.try_to_timestamp("ts_text", F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"),
        request_path(F.col("target")).alias("path"),
        normal_path(F.col("target")).alias("norm_path"),
        *(first_number(F.col(k)).alias(n) for k, n in (("rt", "request_time"), ("uct", "connect_time"), ("uht", "header_time"), ("urt", "response_time"))),
    )


def access_class() -> Column:
    """LOG03: class of a parsed line, the first that applies."""
    bad = F.rlike("target", F.lit(BAD_TARGET)) | F.rlike("user_agent", F.lit(BAD_AGENT))
    return (
        F.when(F.col("status") == 429, "rate_limited")
        .when(bad, "bot_scan")
        .when(F.col("path") == "/favicon.ico", "favicon")
        .when((F.col("path") == "/") & (F.col("method") == "POST"), "root_probe")
        .when(F.col("status") >= 500, "server_error")
        .when(F.col("status") >= 400, "client_error")
        .otherwise("normal")
    )


def parse_error(lines: DataFrame) -> DataFrame:
    """LOG02/LOG04: error lines to fields and class."""
    ok = F.rlike("line", F.lit(ERROR))
    request = F.regexp_extract("line", 'request: "([^"]*)"', 1)
    parts = F.split(F.trim(request), r"\s+")
    whole = F.size(parts) >= 2
    rows = lines.select(
        "line_no",
        "line",
        ok.alias("parsed"),
        F.when(ok, F.regexp_extract("line", ERROR, 1)).alias("ts_text"),
        F.when(ok, F.regexp_extract("line", ERROR, 2)).alias("level"),
        F.trim(F.regexp_extract("line", "client: ([^,]+)", 1)).alias("ip"),
        F.regexp_extract("line", 'host: "([^"]*)"', 1).alias("host"),
        F.when(whole, parts[0]).otherwise("").alias("method"),
        F.when(whole, request_path(parts[1])).otherwise("").alias("path"),
    )
    low = F.lower("path")
    kind = (
        F.when(F.contains("line", F.lit("limiting requests, excess:")), "rate_limited")
        .when(low == "/favicon.ico", "favicon")
        .when(F.rlike(low, F.lit(BAD_TARGET)), "bot_scan")
        .when((F.col("path") == "/") & ((F.col("method") == "POST") | F.contains("line", F.lit("index.html"))), "root_probe")
        .when(F.contains(F.lower("line"), F.lit("no such file or directory")) | F.contains("line", F.lit(" is not found ")), "missing_static")
        .otherwise("other")
    )
    return rows.select("line_no", "parsed", "ts_text", "level", "ip", "host", "method", F.when(F.col("path") == "", "-").otherwise(F.col("path")).alias("path"), F.when(F.col("parsed"), kind).alias("category"))


def since(ts: Column, cutoff: str) -> Column:
    """FLT22: at or after the cutoff; lines without a readable time are kept."""
    return ts.isNull() | (ts >= F.lit(cutoff).cast("timestamp"))


def last_lines(lines: DataFrame, n: int, key: str = "line_no") -> DataFrame:
    """SRC10/WIN09: the last n lines, in their order."""
    return lines.orderBy(F.desc(key)).limit(n).orderBy(key)


def realtime_band(seconds: Column) -> Column:
    """STM05: latency bands of the live view."""
    return F.when(seconds >= 3.0, "critical").when(seconds >= 1.0, "slow").when(seconds >= 0.5, "warn").otherwise("ok")


def read_lines(spark, path: str) -> DataFrame:
    """Lines of text files with a number that follows file order within a file; undecodable bytes are replaced."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
