"""Chat messages, log lines, moderation texts, tool policies and display texts, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import strip_think

# Fixed values.
UNSAFE = {
    "hate_or_slur": ["병신", "좆", "씨발", "시발", "느금마", "니애미", "nigger"],
    "threats": ["죽여", "죽인다", "살해", "폭발", "테러", "불태워"],
    "doxxing": ["주민등록번호", "주민번호", "전화번호", "휴대폰번호", "계좌번호", "주소", "집주소", "신상"],
    "targeted_harassment": ["꺼져", "꺼지라", "찢어", "조져", "때려"],
    "sexual_insults_real_person": ["강간", "성폭행", "섹스", "창녀", "걸레"],
}
HONORIFICS = [r"요(\s|$)", "습니다", "입니", "하세요", "해주세요", "됩니다", "합니다"]
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]
CHANNELS = ["WebChat", "WhatsApp", "Telegram", "Signal", "Slack", "Discord", "iMessage", "Teams", "Matrix", "Zalo", "Zalo Personal", "BlueBubbles"]

_THINK = r"(?is)<\s*think(?:ing)?\s*>(.*?)<\s*/\s*think(?:ing)?\s*>"


def unsafe_rules() -> dict[str, str]:
    """The categories as patterns for `scoring.unsafe`."""
    return {name: "|".join(words) for name, words in UNSAFE.items()}


def honorific(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in HONORIFICS))


def strip_envelope(text: Column) -> Column:
    """Without a leading [header] that names a channel or holds a time."""
    header = F.regexp_extract(text, r"^\[([^\]]+)\]", 1)
    dated = header.rlike(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}Z| \d{2}:\d{2})\b")
    named = reduce(lambda a, b: a | b, (F.startswith(header, F.lit(f"{c} ")) for c in CHANNELS))
    return F.when((header != "") & (dated | named), F.regexp_replace(text, r"^\[[^\]]+\]\s*", "")).otherwise(text)


#: A message's content: items of a type with a text.
ITEMS = "array<struct<type: string, text: string, thinking: string>>"


def raw_text(content: Column, items: Column, text: Column) -> Column:
    """The text of a message: its content string, else its text items by line, else its text field."""
    own = F.filter(items, lambda x: (x["type"] == "text") & x["text"].isNotNull())
    return F.coalesce(content, F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda x: x["text"]), "\n")), text)


def message_text(role: Column, content: Column, items: Column, text: Column) -> Column:
    """raw_text without think blocks (assistant) or envelope (others)."""
    raw = raw_text(content, items, text)
    return F.when(role == "assistant", strip_think(raw)).otherwise(strip_envelope(raw))


def thinking(content: Column, items: Column, text: Column) -> Column:
    """Thinking items by line, else what stands between think tags; null if there is none."""
    full = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    own = full(F.transform(F.filter(items, lambda x: (x["type"] == "thinking") & x["thinking"].isNotNull()), lambda x: x["thinking"]))
    tagged = full(F.regexp_extract_all(raw_text(content, items, text), F.lit(_THINK), F.lit(1)))
    return F.when(F.size(own) > 0, F.array_join(own, "\n")).when(F.size(tagged) > 0, F.array_join(tagged, "\n"))


def message_role(role: Column, tool_id: Column, tool_name: Column, items: Column) -> Column:
    """toolResult if anything tells of a tool, else the role, else unknown."""
    result = F.coalesce(F.exists(items, lambda x: F.lower(F.coalesce(x["type"], F.lit(""))).isin("toolresult", "tool_result")), F.lit(False))
    return F.when(tool_id.isNotNull() | tool_name.isNotNull() | result, "toolResult").otherwise(F.coalesce(role, F.lit("unknown")))


def role_group(role: Column) -> Column:
    return F.when(F.lower(role).isin("toolresult", "tool_result", "tool", "function"), "tool").otherwise(role)


def message_key(tool_id: Column, id_: Column, message_id: Column, role: Column, at: Column, index: Column) -> Column:
    filled = lambda c, prefix: F.when(c != "", F.concat(F.lit(prefix), c))
    last = F.concat_ws(":", F.lit("msg"), F.coalesce(role, F.lit("unknown")), at.cast("string"), index.cast("string"))
    return F.coalesce(filled(tool_id, "tool:"), filled(id_, "msg:"), filled(message_id, "msg:"), last)


def _json_text(value: Column, path: str) -> Column:
    """A JSON field if it is a string (null if it is a number, object or absent)."""
    variant = F.try_parse_json(value)
    return F.when(F.schema_of_variant(F.variant_get(variant, path, "variant")) == "STRING", F.try_variant_get(variant, path, "string"))


def log_line(line: Column) -> Column:
    """struct(time, level, subsystem, message) of a JSON log line; a line that is no JSON object is its own message."""
    context = F.coalesce(_json_text(line, "$['0']"), _json_text(line, "$._meta.name"))
    inner = F.when(context.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(context).isNotNull(), context)
    level = F.lower(F.coalesce(_json_text(line, "$._meta.logLevelName"), _json_text(line, "$._meta.level")))
    subsystem = F.coalesce(_json_text(inner, "$.subsystem"), _json_text(inner, "$.module"))
    subsystem = F.coalesce(F.nullif(subsystem, F.lit("")), F.when(F.length(context) < 120, F.nullif(context, F.lit(""))))
    message = F.coalesce(_json_text(line, "$['1']"), F.when(inner.isNull(), _json_text(line, "$['0']")), _json_text(line, "$.message"), line)
    return F.struct(
        F.coalesce(_json_text(line, "$.time"), _json_text(line, "$._meta.date")).alias("time"),
        F.when(level.isin(*LEVELS), level).alias("level"), subsystem.alias("subsystem"), message.alias("message"),
    )


def log_matches(levels: list[str], needle: str, level: Column, *fields: Column) -> Column:
    """Whether a line has one of the levels (or none) and the needle in its known fields."""
    ok = level.isNull() | level.isin(*levels)
    return ok & F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle.strip().lower())) if needle.strip() else ok


def _glob(pattern: str) -> str:
    return "^" + ".*".join(re.escape(p) for p in pattern.strip().lower().split("*")) + "$"


def allowed(name: Column, allow: list[str], deny: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Tool policy by globs: deny wins, an empty allow list allows all, and an alias is allowed with what it stands for."""
    low = F.lower(F.btrim(name))
    matches = lambda value, globs: reduce(lambda a, b: a | b, (value.rlike(_glob(g)) for g in globs if g.strip()), F.lit(False))
    ok = matches(low, allow) if allow else F.lit(True)
    for alias, stands_for in (aliases if aliases is not None else {"apply_patch": "exec"}).items():
        ok = ok | ((low == alias) & matches(F.lit(stands_for), allow))
    return ~matches(low, deny) & ok


def _steps(seconds: Column, unit: list[str]) -> Column:
    """Seconds, minutes, hours below 48, or days, each rounded from the one before."""
    whole = lambda c: F.floor(c + 0.5).cast("long")
    minutes = whole(seconds / 60)
    hours = whole(minutes / 60)
    text = lambda n, k: F.concat(n.cast("string"), F.lit(unit[k]))
    return F.when(seconds < 60, text(seconds, 0)).when(minutes < 60, text(minutes, 1)).when(hours < 48, text(hours, 2)).otherwise(text(whole(hours / 24), 3))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, to the nearest; halves go away from 1970."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    nearest = F.call_function("div", F.abs(us) + 500, F.lit(1000))
    return F.when(us < 0, -nearest).otherwise(nearest)


def age_text(milliseconds: Column) -> Column:
    """Time since, from its length; "n/a" if unknown and "just now" if in the future."""
    seconds = F.floor(milliseconds / 1000 + 0.5).cast("long")
    return F.when(milliseconds.isNull(), "n/a").when(milliseconds < 0, "just now").otherwise(_steps(seconds, ["s ago", "m ago", "h ago", "d ago"]))


def duration_text(milliseconds: Column) -> Column:
    seconds = F.floor(milliseconds / 1000 + 0.5).cast("long")
    short = F.concat(milliseconds.cast("string"), F.lit("ms"))
    return F.when(milliseconds.isNull(), "n/a").when(milliseconds < 1000, short).otherwise(_steps(seconds, ["s", "m", "h", "d"]))


def clamp(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(0, most - 1))), F.lit("…")))


def truncated(text: Column, most: int) -> Column:
    return F.struct(F.left(text, F.lit(most)).alias("text"), (F.length(text) > most).alias("truncated"), F.length(text).cast("long").alias("total"))


def byte_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB"), tenths: tuple[str, ...] = ()) -> Column:
    """Bytes as B or in the largest of the units that they fill; one decimal below ten, and always in the units of `tenths`."""
    text = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, 1):
        size = n / float(1024**power)
        decimal = F.format_string("%.1f", F.floor(n / (1024**power / 10) + 0.5) / 10)
        shown = decimal if unit in tenths else F.when(size < 10, decimal).otherwise(F.format_string("%.0f", F.floor(size + 0.5).cast("double")))
        text = F.when(n >= 1024**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(text)
    return F.when(n.isNull(), "-").otherwise(text)


def list_text(values: Column) -> Column:
    full = F.filter(values, lambda v: F.btrim(v) != "")
    return F.when(values.isNull() | (F.size(values) == 0), "none").otherwise(F.array_join(full, ", "))


def parse_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,\n]"), lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: v != "")


def number_or(text: Column, fallback: float) -> Column:
    own = F.btrim(text)
    value = F.when(own == "", F.lit(0.0)).otherwise(own.try_cast("double"))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(float(fallback))).otherwise(value)


def session_tokens(total: Column, context: Column) -> Column:
    both = F.concat(total.cast("string"), F.lit(" / "), context.cast("string"))
    return F.when(total.isNull(), "n/a").when(F.coalesce(context, F.lit(0)) != 0, both).otherwise(total.cast("string"))


def schedule_text(kind: Column, at: Column, every: Column, cron: Column, zone: Column) -> Column:
    """When a job runs: at a time, every so long, or by a cron expression."""
    by_cron = F.concat(F.lit("Cron "), cron, F.coalesce(F.concat(F.lit(" ("), F.nullif(zone, F.lit("")), F.lit(")")), F.lit("")))
    return F.when(kind == "at", F.concat(F.lit("At "), at)).when(kind == "every", F.concat(F.lit("Every "), duration_text(every))).otherwise(by_cron)


def presence_text(host: Column, ip: Column, mode: Column, version: Column) -> Column:
    shown = F.when(ip != "", F.concat(F.lit("("), ip, F.lit(")"))).otherwise("")
    parts = [F.coalesce(host, F.lit("unknown")), F.coalesce(shown, F.lit("")), F.coalesce(mode, F.lit("")), F.coalesce(version, F.lit(""))]
    return F.btrim(F.concat_ws(" ", *parts))


def connected(summary: Column, age_seconds: Column, most: int = 25 * 60, key: str = "loopSummary") -> Column:
    """Whether a heartbeat is recent and its JSON summary has the key."""
    known = F.try_variant_get(F.try_parse_json(summary), f"$.{key}", "variant").isNotNull()
    return F.coalesce((age_seconds <= most) & known, F.lit(False))
