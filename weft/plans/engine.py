"""From query text to a lazy DataFrame.

Spark parses, analyses and plans. What is added here is small: directives that Spark's SQL
has not are taken off the text, parameters get names, limits on a query's size are held,
and Spark's error conditions are reported under the portable codes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans import gate

# The portable codes of Spark's error conditions.
CODES = {
    "TABLE_OR_VIEW_NOT_FOUND": "QF0005",
    "CANNOT_RESOLVE_STAR_EXPAND": "QF0007",
    "UNRESOLVED_ROUTINE": "QF0013",
    "UNRESOLVED_COLUMN": "QF0015",
    "AMBIGUOUS_REFERENCE": "QF0016",
    "UNBOUND_SQL_PARAMETER": "QF0018",
    "NUM_COLUMNS_MISMATCH": "QF0022",
    "INVALID_SUBQUERY_EXPRESSION": "QF0023",
    "DATATYPE_MISMATCH": "QF0024",
    "PARSE_SYNTAX_ERROR": "parse",
}
# What FORMAT may name.
FORMATS = ("arrow", "parquet", "csv", "json", "orc")
# The most bytes and parameters of a query.
MOST_BYTES, MOST_PARAMETERS = 1 << 20, 256


class QueryError(ValueError):
    """A query that cannot be run: a code and Spark's message."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Query:
    """text for Spark, the same with its literals emptied, and what was taken off: explain, scope, download format, result format, settings."""

    text: str
    shape: str = ""
    explain: bool = False
    scope: str = "local"
    download: str | None = None
    format: str | None = None
    settings: dict[str, str] = field(default_factory=dict)


_MASKED = re.compile(r"'(?:[^']|\'\')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)
#: Where a directive stands on a line of its own; its value.
_LINES = {"scope": r"scope[ \t]+(\w+)", "download": r"download[ \t]+(\w+)"}


def prepare(text: str) -> Query:
    """Takes off EXPLAIN, SCOPE s, DOWNLOAD f, FORMAT f and SETTINGS k = v; lets a query begin with FROM; names parameters.

    SCOPE and DOWNLOAD stand on lines of their own, FORMAT (one of FORMATS) and SETTINGS at the
    end. ``$n`` becomes ``:pn``, each ``?`` the next number, ``@n`` becomes ``:n``. Nothing is
    changed within literals and quoted names; comments go.
    """
    kept: list[str] = []

    def mask(m):
        if m[0][0] in "-/":
            return " "
        kept.append(m[0])
        return f"\0{len(kept) - 1}\0"

    body = _MASKED.sub(mask, text).strip().rstrip(";").strip()
    if not body:
        raise QueryError("parse", "empty query")
    if len(text.encode()) > MOST_BYTES:
        raise QueryError("budget", f"more than {MOST_BYTES} bytes")
    found: dict = {}
    if m := re.match(r"explain\s+", body, re.I):
        body, found["explain"] = body[m.end() :], True
    for name, line in _LINES.items():
        if (m := re.search(rf"^[ \t]*{line}[ \t]*;?[ \t]*$", body, re.I | re.M)) and body[: m.start()].strip():
            body, found[name] = f"{body[: m.start()]}{body[m.end() :]}".strip(), m[1].lower()
    if m := re.search(r"\ssettings\s+(\w+\s*=\s*[\w.]+(?:\s*,\s*\w+\s*=\s*[\w.]+)*)\s*$", body, re.I):
        body, found["settings"] = body[: m.start()], dict(re.split(r"\s*=\s*", x.strip()) for x in m[1].split(","))
    if m := re.search(rf"\sformat\s+({'|'.join(FORMATS)})\s*$", body, re.I):
        body, found["format"] = body[: m.start()], m[1].lower()
    if re.match(r"from\s", body, re.I):
        body = f"SELECT * {body}"
    count = iter(range(1, MOST_PARAMETERS + 2))
    body = re.sub(r"\?", lambda _: f":p{next(count)}", body)
    body = re.sub(r"\$(\d+)", r":p\1", body)
    body = re.sub(r"(?<![\w@])@(\w+)", r":\1", body)
    if len(set(re.findall(r":(\w+)", body))) > MOST_PARAMETERS:
        raise QueryError("budget", f"more than {MOST_PARAMETERS} parameters")
    whole = lambda empty: re.sub(r"\0(\d+)\0", lambda m: "''" if empty and kept[int(m[1])][0] == "'" else kept[int(m[1])], body)
    return Query(whole(False), shape=whole(True), **found)


def dataframe(spark: SparkSession, text: str, values: list | dict | None = None, strict: bool = True) -> DataFrame:
    """The query as a lazy, analysed DataFrame; QueryError where it has none. A list gives parameters 1, 2 and so on.

    EXPLAIN gives the plan as text, in column ``plan``. strict: what lies outside the portable
    subset is refused (see gate); otherwise Spark's own SQL runs.
    """
    query = prepare(text)
    args = {f"p{i}": v for i, v in enumerate(values, 1)} if isinstance(values, list) else dict(values or {})
    if strict and (why := gate.refusal(spark, query.shape)):
        raise QueryError(*why)
    body = f"EXPLAIN FORMATTED {query.text}" if query.explain else query.text
    try:
        return spark.sql(body, args=args) if args else spark.sql(body)
    except PySparkException as error:
        condition = error.getCondition() or ""
        raise QueryError(CODES.get(condition.split(".")[0], condition or "spark"), str(error).split("\n")[0]) from error


def query_hash(text: str) -> str:
    """A digest of what a query asks for: its prepared text, with single spaces outside literals."""
    query = prepare(text)
    parts = re.split(r"('(?:[^']|\'\')*'|`[^`]*`)", query.text)
    plain = "".join(x if i % 2 else re.sub(r"\s+", " ", x) for i, x in enumerate(parts)).strip()
    return f"sha2-256:{hashlib.sha256(plain.encode()).hexdigest()}"


def bounded(df: DataFrame, most: int = 1000, most_bytes: int = 4 << 20) -> tuple[list, bool]:
    """At most so many rows, and as few as have so many bytes as JSON (one at least), for showing, and whether there are more."""
    rows = df.limit(most + 1).select("*", F.length(F.to_json(F.struct("*"))).alias("_bytes")).collect()
    shown, size = [], 0
    for row in rows[:most]:
        size += row["_bytes"] or 0
        if shown and size > most_bytes:
            break
        shown.append(type(row)(**{k: v for k, v in row.asDict().items() if k != "_bytes"}) if len(set(row.__fields__)) == len(row) else row[:-1])
    return shown, len(shown) < len(rows)
