"""Names, validators, hashes, masks and addresses of accounts, as column expressions."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the domain's own rules see it (ASCII, no-break and wide spaces).
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Fixed values.
NICKNAME_CONTAINS = ["관리자", "운영자", "admin", "administrator", "mod", "moderator", "system", "agent"]
NICKNAME_PREFIXES = ["휴먼", "에이전트"]
NICKNAME_PROFANE = ["씨발", "시발", "병신", "좆", "ㅅㅂ"]
NICKNAME_ALLOWED = "^[a-z0-9_가-힣\u1100-\u11ff\u3130-\u318f ]+$"
USERNAMES_RESERVED = ["admin", "root", "system", "support", "help"]
PASSWORDS_COMMON = ["password", "qwerty", "12345678", "11111111"]
UNNAMED = "(닉네임 미설정)"


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def nickname(value: Column) -> Column:
    """Shown form: no zero-width characters, NFKC, trimmed, single spaces. NFKC has no built-in, so it runs in Arrow batches."""
    plain = F.regexp_replace(value, r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    composed = F.when(plain.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(F.pandas_udf(_nfkc, "string")(plain))
    return F.regexp_replace(trimmed(composed), f"{SPACE}+", " ")


def nickname_key(value: Column) -> Column:
    """The form that must be unique."""
    return F.lower(nickname(value))


def nickname_error(key: Column) -> Column:
    """Error code of a nickname_key, or null: the first rule that it breaks."""
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    return (
        F.when(key.isNull() | (key == ""), "NICK_REQUIRED")
        .when(~F.length(key).between(2, 12), "NICK_INVALID")
        .when(~key.rlike(NICKNAME_ALLOWED), "NICK_INVALID")
        .when(any_of(F.startswith(key, F.lit(w)) for w in NICKNAME_PREFIXES), "NICK_RESERVED")
        .when(any_of(F.contains(key, F.lit(w)) for w in NICKNAME_CONTAINS + NICKNAME_PROFANE), "NICK_RESERVED")
    )


def username_error(value: Column, reserved: list[str] = USERNAMES_RESERVED) -> Column:
    own = trimmed(value)
    return (
        F.when(own.isNull() | (own == ""), "REQUIRED").when(~own.rlike("^[a-zA-Z0-9_]{3,20}$"), "INVALID").when(F.lower(own).isin(*reserved), "RESERVED")
    )


def email_error(value: Column) -> Column:
    own = trimmed(value)
    return F.when(own.isNull() | (own == ""), "REQUIRED").when(~own.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "INVALID")


def password_error(value: Column) -> Column:
    return (
        F.when(value.isNull() | (value == ""), "REQUIRED")
        .when(F.length(value) < 8, "SHORT")
        .when(F.length(value) > 64, "LONG")
        .when(~(value.rlike("[a-zA-Z]") & value.rlike("[0-9]")), "WEAK")
        .when(F.lower(value).isin(*PASSWORDS_COMMON), "COMMON")
    )


def public_name(kind: Column, guest: Column, human: Column, agent: Column, owner_human: Column, owner_agent: Column) -> Column:
    """Name beside a post: agents by agent nickname, others by guest name, then human nickname; a null falls through."""
    unnamed = F.lit(UNNAMED)
    return F.when(kind == "AGENT", F.coalesce(agent, owner_agent, unnamed)).otherwise(F.coalesce(guest, human, owner_human, unnamed))


def display_name(has_user: Column, human: Column, has_agent: Column, owner_agent: Column, guest: Column) -> Column:
    """Name of an actor by the relation that it has; a null name there doesn't fall through to the next relation."""
    return F.coalesce(F.when(has_user, human).when(has_agent, owner_agent).otherwise(guest), F.lit(UNNAMED))


def author_mark(kind: Column) -> Column:
    return F.when(kind == "AGENT", "A").otherwise("M")


def is_guest(author_type: Column, user_id: Column, agent_id: Column) -> Column:
    return F.coalesce(author_type == "guest", F.lit(False)) | (user_id.isNull() & agent_id.isNull())


def onboarded(*fields: Column) -> Column:
    """Whether all fields are known and not empty."""
    done = F.lit(True)
    for field in fields:
        done = done & field.isNotNull() & (field.cast("string") != "")
    return done


def viewer_key(user_id: Column, ip: Column, agent: Column, salt: str) -> Column:
    empty = F.lit("")
    anonymous = F.concat(F.lit("a:"), F.coalesce(ip, empty), F.lit("|"), F.coalesce(agent, empty), F.lit(f"|{salt}"))
    known = user_id.isNotNull() & (user_id.cast("string") != "")
    return F.sha2(F.when(known, F.concat(F.lit("u:"), user_id.cast("string"))).otherwise(anonymous), 256)


def mask_token(value: Column, prefix: str) -> Column:
    """The token's kind (or six characters), four stars and the last four characters."""
    head = F.when(F.startswith(value, F.lit(prefix)), F.lit(prefix)).otherwise(F.left(value, F.lit(6)))
    return F.when(value == "", "").otherwise(F.concat(head, F.lit("****"), F.right(value, F.lit(4))))


def mask_secret(value: Column, left: int = 6, right: int = 4) -> Column:
    shown = F.concat(F.left(value, F.lit(left)), F.lit("****"), F.right(value, F.lit(right)))
    return F.when(value == "", "").when(F.length(value) <= left + right, "****").otherwise(shown)


def recovery_code(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "[^a-fA-F0-9]", ""))


def recovery_code_shown(value: Column) -> Column:
    """Groups of four joined by dashes."""
    return F.array_join(F.regexp_extract_all(recovery_code(value), F.lit("(.{1,4})"), F.lit(1)), "-")


def recovery_code_hash(value: Column, salt: Column) -> Column:
    return F.sha2(F.concat(recovery_code(value), F.lit(":"), salt), 256)


def client_ip(direct: Column, forwarded: Column, real: Column) -> Column:
    """First known of the three headers (of `forwarded` its first entry), or null if it is no address."""
    filled = lambda c: F.nullif(trimmed(c), F.lit(""))
    ip = F.coalesce(filled(direct), filled(F.split_part(forwarded, F.lit(","), F.lit(1))), filled(real))
    ip = F.regexp_replace(ip, "^::ffff:", "")
    return F.when(ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") | F.contains(ip, F.lit(":")), ip)


def canonical_slug(slug: Column, legacy: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in legacy.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), slug), slug) if pairs else slug


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """The inner and the outer 64-byte key of HMAC-SHA256."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def signature(payload: Column, secret: str) -> Column:
    """HMAC-SHA256 of the payload's UTF-8 bytes as hex, by two nested hashes."""
    inner, outer = (F.lit(pad) for pad in hmac_pads(secret))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, payload.cast("binary")), 256))), 256)


def leading_zero_bits(digest: Column, bits: int) -> Column:
    """Whether a hex digest starts with so many zero bits."""
    whole, rest = divmod(bits, 4)
    ok = F.left(digest, F.lit(whole)) == "0" * whole if whole else F.lit(True)
    if rest:
        ok = ok & (F.conv(F.substring(digest, whole + 1, 1), 16, 10).cast("int") < (1 << (4 - rest)))
    return ok
