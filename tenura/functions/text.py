"""Column expressions for personal data, query checks and intents. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura.config import BLOCKED_SQL, MASK_TOKEN

# Patterns of the personal data to find. Digits and spaces are meant in the Unicode
# sense, so they are written as character properties.
_D = r"\p{Nd}"
_SPACES = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_S = rf"[{_SPACES}]"
NATIONAL_ID = rf"{_D}{{3}}\.?{_D}{{3}}\.?{_D}{{3}}-?{_D}{{2}}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = rf"\(?{_D}{{2}}\)?{_S}?{_D}{{4,5}}-?{_D}{{4}}"
NAME = rf"(?iu)(?:name|nome)[:{_SPACES}]+[A-Z][a-z]+ [A-Z][a-z]+"
MEMBER_ID = (rf"(?i)member[_{_SPACES}]?(?:id)?[:{_SPACES}]+([A-Za-z0-9_-]+)", rf"(?i)(MEM_{_D}+)")
NUMBER = r"\d+(?:\.\d+)?"

# Words that decide the intent of a question, in order of precedence.
INTENTS = (
    ("prescriptive", 0.85, ("should", "recommend", "optimize", "allocate", "budget", "action", "what to do", "strategy",
                            "intervention", "best approach", "how to reduce")),
    ("diagnostic", 0.82, ("why", "cause", "reason", "driver", "explain", "diagnose", "root cause", "what happened",
                          "trend", "compared to", "difference")),
    ("factual", 0.88, ("how many", "what is", "show me", "list", "count", "total", "current", "score", "churn rate",
                       "metrics", "members")),
)
DEFAULT_INTENT = ("conversational", 0.6)


def _literal(token: str) -> str:
    """The token with the characters that are special in a replacement escaped."""
    return token.replace("\\", "\\\\").replace("$", "\\$")


def mask_text(text: Column, token: str = MASK_TOKEN) -> Column:
    """Replace national ids, then e-mail addresses, then phone numbers."""
    for pattern in (NATIONAL_ID, EMAIL, PHONE):
        text = F.regexp_replace(text, pattern, _literal(token))
    return text


def leak_types(text: Column) -> Column:
    """Kinds of personal data found, as an array in fixed order."""
    found = [F.when(text.rlike(p), F.lit(n)) for n, p in (("cpf", NATIONAL_ID), ("email", EMAIL), ("phone", PHONE))]
    return F.array_compact(F.array(*found))


def leaks(text: Column) -> Column:
    """Whether a response holds personal data, including a labelled first and last name."""
    return text.rlike(NATIONAL_ID) | text.rlike(EMAIL) | text.rlike(PHONE) | text.rlike(NAME)


def sql_rule(sql: Column, blocked: Sequence[str] = tuple(BLOCKED_SQL)) -> Column:
    """The rule a statement breaks, or null when it only reads."""
    upper = F.upper(F.trim(F.regexp_replace(sql, r"^\s+|\s+$", "")))
    rule = F.when(~(upper.startswith("SELECT") | upper.startswith("WITH")), F.lit("sql_readonly"))
    for pattern in reversed(list(blocked)):
        rule = F.when(upper.rlike(pattern), F.lit(f"sql_safety: {pattern}")).otherwise(rule)
    return rule


def intent(text: Column) -> Column:
    """Struct of intent and confidence; the first list with a word in the text decides."""
    low = F.lower(text)
    out = F.struct(F.lit(DEFAULT_INTENT[0]).alias("query_type"), F.lit(DEFAULT_INTENT[1]).alias("confidence"))
    for name, confidence, words in reversed(INTENTS):
        hit = reduce(or_, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(hit, F.struct(F.lit(name).alias("query_type"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def member_id_in(text: Column) -> Column:
    none = F.lit("")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), none) for p in MEMBER_ID])
