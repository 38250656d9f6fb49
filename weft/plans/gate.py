"""What of Spark's SQL lies outside the portable subset.

Spark parses a query; its unresolved plan, as text, shows what was asked for. Literals are
emptied before, so that nothing in them counts.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# The portable codes of what is refused, by what Spark's unresolved plan has for it.
REFUSED = {
    r"Join (UsingJoin|NaturalJoin|LeftSemi|LeftAnti)|LateralJoin|AsOfJoin": ("QF0000", "a join other than inner, left, right, full or cross with ON"),
    r"Distinct\s*\n[^\w']*'?Union|Intersect |Except ": ("QF0002", "a set operation other than UNION ALL"),
    r"Aggregate \[[^\n]*?'ALL\]": ("QF0012", "GROUP BY ALL"),
    r"\b(rollup|cube|groupingsets)\(Vector": ("QF0012", "ROLLUP, CUBE or GROUPING SETS"),
    r"specifiedwindowframe\((Row|Range)Frame|WithWindowDefinition": ("QF0000", "a window frame or a named window"),
    r"'Sort \['ALL |'Sort \[[^\n]*\], false|RepartitionByExpression|WithCTE|PipeOperator|Sample |Pivot |Unpivot |Generate ": ("QF0000", "a clause of Spark's own"),
    r"InsertIntoStatement|CreateTable|DropTable|DeleteFromTable|UpdateTable|MergeIntoTable|SetCommand|SetCatalog": ("QF0000", "a statement that is no query"),
}
#: The same by words, for what the plan doesn't show.
_WORDS = {
    r"\bwith\s+recursive\b": ("QF0001", "WITH RECURSIVE"),
    r"\bwithin\s+group\b|\b(ignore|respect)\s+nulls\b": ("QF0000", "WITHIN GROUP or null treatment"),
    r"\bfetch\s+(first|next)\b|\bfor\s+(update|share)\b": ("QF0000", "FETCH or a lock"),
    r"\bqualify\b": ("QF0000", "QUALIFY"),
}
# The most joins, common table expressions, levels of brackets, and words and signs of a query.
MOST_JOINS, MOST_CTES, MOST_DEPTH, MOST_NODES = 256, 256, 64, 10_000


def _oversize(text: str) -> str | None:
    """What of a query, its literals emptied, there is more of than is allowed."""
    depth = most = 0
    for sign in re.findall(r"[()]", text):
        depth += 1 if sign == "(" else -1
        most = max(most, depth)
    joins = len(re.findall(r"\bjoin\b", text, re.I))
    ctes = len(re.findall(r"\bas\s*\(\s*select\b", text, re.I)) if re.match(r"\s*with\b", text, re.I) else 0
    found = {"joins": (joins, MOST_JOINS), "common table expressions": (ctes, MOST_CTES), "levels": (most, MOST_DEPTH), "nodes": (len(re.findall(r"\w+|[^\s\w]", text)), MOST_NODES)}
    return next((f"more than {limit} {what}" for what, (n, limit) in found.items() if n > limit), None)


def refusal(spark: SparkSession, text: str) -> tuple[str, str] | None:
    """The code and reason for which a query, its literals emptied, is refused; None if it is in the subset, or Spark can't parse it."""
    if over := _oversize(text):
        return "budget", over
    for words, why in _WORDS.items():
        if re.search(words, text, re.I):
            return why
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    except Exception:  # noqa: BLE001  Spark reports it when the query itself is parsed
        return None
    for shown, why in REFUSED.items():
        if re.search(shown, plan):
            return why
    return None
