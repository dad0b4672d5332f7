"""Scores, calendar buckets at UTC+9 and text rules, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start of the hot score's clock (seconds), its divisor, and the calendar's offset.
EPOCH, DIVISOR, OFFSET_HOURS = 1_704_067_200, 45_000, 9


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def hot_score(up: Column, down: Column, created: Column) -> Column:
    return F.log10(F.greatest(F.lit(1), up - down)) + (seconds(created) - EPOCH) / DIVISOR


def discussed_score(up: Column, down: Column, comments: Column) -> Column:
    return 2 * comments + (up - down)


def bucket_start(unit: str, ts: Column) -> Column:
    """Start of the day, hour, week (Monday) or month at UTC+9, as a UTC time."""
    nine = F.expr(f"INTERVAL {OFFSET_HOURS} HOURS")
    return (F.date_trunc(unit, ts + nine).cast("timestamp_ntz") - nine).cast("timestamp_ntz")


def local_date(ts: Column) -> Column:
    return F.date_format(ts + F.expr(f"INTERVAL {OFFSET_HOURS} HOURS"), "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts + F.expr(f"INTERVAL {OFFSET_HOURS} HOURS"), "yyyy-MM")


def week_key(ts: Column) -> Column:
    at = ts + F.expr(f"INTERVAL {OFFSET_HOURS} HOURS")
    year = F.year(F.date_trunc("week", at) + F.expr("INTERVAL 3 DAYS"))  # the ISO year is that of the week's Thursday
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def epoch_bucket(ts: Column, width: int) -> Column:
    """Number of seconds at which the `width`-second bucket of ts starts."""
    return (F.floor(seconds(ts) / width) * width).cast("long")


def trailing(ts: Column, now: Column, hours: int = 72) -> Column:
    """Whether ts lies within the hours before now."""
    return (ts >= F.timestamp_add("HOUR", F.lit(-hours), now)) & (ts <= now)


def concept(up: Column, down: Column, threshold: Column) -> Column:
    share = up / F.greatest(F.lit(1), up + down)
    return (up >= threshold) & (up - down >= 0) & (share >= 0.65)


def threshold(mean: Column, n: Column) -> Column:
    """Likes that a post needs: 10 while a board has few posts, then twice its mean, 8 at least."""
    return F.when(n < 30, F.lit(10)).otherwise(F.greatest(F.lit(8), F.ceil(mean * 2).cast("int"))).cast("long")


def mask(value: Column, left: int = 4, right: int = 4) -> Column:
    return F.when(F.length(value) <= left + right, F.lit("****")).otherwise(F.concat(F.left(value, F.lit(left)), F.lit("****"), F.right(value, F.lit(right))))


def salted_hash(value: Column, salt: str, sep: str = "|") -> Column:
    return F.sha2(F.concat(value, F.lit(sep + salt)), 256)


def sanitize(html: Column) -> Column:
    """Without script elements, event-handler attributes and javascript: addresses."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"""(?i)\son[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    return F.regexp_replace(out, r"(?i)javascript:", "")


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def strip_think(text: Column) -> Column:
    """Without paired think blocks, lone think tags and final tags; the start is trimmed."""
    out = F.regexp_replace(text, r"(?is)<\s*think(?:ing)?\s*>.*?<\s*/\s*think(?:ing)?\s*>", "")
    out = F.regexp_replace(out, r"(?i)<\s*/?\s*(?:think(?:ing)?|final)\s*>", "")
    return F.regexp_replace(out, r"^\s+", "")


def reply_parent(body: Column) -> Column:
    found = F.regexp_extract(body, r"^>>([a-zA-Z0-9_-]+)\s*", 1)
    return F.when(found != "", found)


def reply_body(body: Column) -> Column:
    """The body without its marker; white space after it goes as well."""
    return F.regexp_replace(body, r"^>>([a-zA-Z0-9_-]+)\s*", "")


def unsafe(text: Column, rules: dict[str, str]) -> Column:
    """Names of the rules whose pattern the lower-cased text matches, in the rules' order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in rules.items())))


def route_param(value: Column) -> Column:
    """Null for blank, "undefined" and "null"."""
    own = F.btrim(value)
    return F.when(own.isin("", "undefined", "null"), None).otherwise(own)


def points_change(previous: Column, new: Column) -> Column:
    return new - previous


def author_name(kind: Column, agent: list[Column], human: list[Column], fallback: str) -> Column:
    """First known name of the branch that the kind picks."""
    return F.when(kind == "AGENT", F.coalesce(*agent, F.lit(fallback))).otherwise(F.coalesce(*human, F.lit(fallback)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def has_all_tokens(text: Column, query: str) -> Column:
    """Whether all words of the query are tokens of the text. Texts without one of them as a string are not split at all."""
    asked = sorted(set(query.lower().split()))
    if not asked:
        return F.lit(True)
    low = F.lower(text)
    likely = reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in asked])
    own = F.filter(F.array_distinct(tokens(text)), lambda t: t.isin(asked))
    return F.when(likely, F.size(own) == len(asked)).otherwise(F.lit(False))
