"""Request parameters and event routing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import SPACE, trimmed

# Fixed values.
DEFAULT_LIMIT, MAX_LIMIT, MAX_PAGE, QUERY_MIN, QUERY_MAX = 30, 50, 200, 2, 120
TABS = ["all", "concept", "notice"]
SORTS = ["new", "hot", "top", "discussed"]
AUTHORS = ["all", "human", "agent"]
SCOPES = ["title_body", "title", "body", "author"]


def leading_int(value: Column) -> Column:
    """The whole number that a text starts with, after white space of any kind, else null. Numbers of over 18 digits stand as the largest of 18."""
    digits = F.regexp_extract(value, f"^{SPACE}*[+-]?0*([0-9]+)", 1)
    sign = F.when(F.regexp_extract(value, f"^{SPACE}*([+-]?)", 1) == "-", -1).otherwise(1)
    return sign * F.when(F.length(digits) > 18, F.lit(10**18 - 1)).otherwise(digits.try_cast("long"))


def allowed(value: Column, names: list[str], fallback: str) -> Column:
    return F.when(value.isin(names), value).otherwise(F.lit(fallback))


def limit(value: Column) -> Column:
    """Rows of a page: a positive number, MAX_LIMIT at most, else DEFAULT_LIMIT."""
    n = leading_int(value)
    return F.when(n > 0, F.least(n, F.lit(MAX_LIMIT))).otherwise(F.lit(DEFAULT_LIMIT))


def query_error(text: Column) -> Column:
    """SHORT or LONG for a search text, null for a good or absent one."""
    n = F.octet_length(F.encode(trimmed(text), "UTF-16BE")) / 2  # as browsers count
    return F.when(text == "", None).when(n < QUERY_MIN, "SHORT").when(n > QUERY_MAX, "LONG")


def page_error(page: Column) -> Column:
    return F.when(page > MAX_PAGE, "DEEP")


def routed(stream: Column, session: Column, run: Column, call: Column, own_session: Column, own_run: Column) -> Column:
    """Whether a tool event belongs to the session and run that are open: another session's event doesn't, nor one of another run;
    without an open run none does. An empty session or run is none."""
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    same_session = ~known(session) | F.coalesce(session == own_session, F.lit(False))
    return (F.coalesce(stream, F.lit("")) == "tool") & same_session & known(own_run) & F.coalesce(run == own_run, F.lit(False)) & known(call)
