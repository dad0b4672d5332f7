"""Queries on names, validators, hashes, masks and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import scoring as S
from ..operators import writes as W
from ..sources.tables import table
from .registry import NOW, now, query

_NAMES = "SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'AGENT' ELSE 'HUMAN' END AS kind, CASE WHEN c_custkey % 7 = 0 THEN 'guest' || c_custkey END AS guest, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS human, CASE WHEN c_custkey % 5 <> 0 THEN 'bot ' || c_custkey END AS agent FROM customer"


def _names(spark, d):
    c, id_ = table(spark, d, "customer"), F.col("c_custkey")
    return c.select(
        id_.alias("id"), F.when(F.col("c_nationkey") % 3 == 0, "AGENT").otherwise("HUMAN").alias("kind"), F.when(id_ % 7 == 0, F.concat(F.lit("guest"), id_)).alias("guest"),
        F.when(id_ % 2 == 0, F.col("c_name")).alias("human"), F.when(id_ % 5 != 0, F.concat(F.lit("bot "), id_)).alias("agent"),
    )


@query("f15_public_name", f"SELECT id, CASE WHEN kind = 'AGENT' THEN coalesce(agent, '{I.UNNAMED}') ELSE coalesce(guest, human, '{I.UNNAMED}') END AS name, CASE WHEN kind = 'AGENT' THEN 'A' ELSE 'M' END AS mark FROM ({_NAMES})")
def _(spark, d):
    none = F.lit(None).cast("string")
    name = I.public_name(F.col("kind"), F.col("guest"), F.col("human"), F.col("agent"), none, none)
    return _names(spark, d).select("id", name.alias("name"), I.author_mark(F.col("kind")).alias("mark"))


@query("f16_display_name", f"SELECT id, coalesce(CASE WHEN kind = 'HUMAN' THEN human WHEN id % 4 = 0 THEN agent ELSE guest END, '{I.UNNAMED}') AS name FROM ({_NAMES})")
def _(spark, d):
    name = I.display_name(F.col("kind") == "HUMAN", F.col("human"), F.col("id") % 4 == 0, F.col("agent"), F.col("guest"))
    return _names(spark, d).select("id", name.alias("name"))


@query("f18_guest_flag", f"SELECT id, guest IS NOT NULL OR (human IS NULL AND agent IS NULL) AS is_guest FROM ({_NAMES})")
def _(spark, d):
    kind = F.when(F.col("guest").isNotNull(), "guest").otherwise("member")
    return _names(spark, d).select("id", I.is_guest(kind, F.col("human"), F.col("agent")).alias("is_guest"))


@query("p24_onboarded", f"SELECT id, human IS NOT NULL AND agent IS NOT NULL AS done FROM ({_NAMES})")
def _(spark, d):
    return _names(spark, d).select("id", I.onboarded(F.col("human"), F.col("agent")).alias("done"))


# Part names hold reserved words only by chance, so a third of them get one.
_RAW = "CASE WHEN p_partkey % 3 = 0 THEN upper(left(p_name, 4)) || ' Mod' WHEN p_partkey % 3 = 1 THEN '  ' || p_name || ' ' ELSE left(p_name, p_partkey % 4) END"


def _raw():
    id_, name = F.col("p_partkey"), F.col("p_name")
    return F.when(id_ % 3 == 0, F.concat(F.upper(F.left(name, F.lit(4))), F.lit(" Mod"))).when(id_ % 3 == 1, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(F.left(name, (id_ % 4).cast("int")))


@query("f21_nickname", f"SELECT p_partkey, lower(regexp_replace(trim({_RAW}), ' +', ' ', 'g')) AS key FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", I.nickname_key(_raw()).alias("key"))


# Full-width letters and digits, wide spaces and zero-width characters around and within; U+212B is composed to U+00C5.
@query("f21_wide_nickname", "SELECT p_partkey, lower(replace(p_name, '_', '') || ' a' || p_size || chr(197)) AS key FROM part")
def _(spark, d):
    plain = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    wide = F.translate(F.concat(F.replace("p_name", F.lit("_")), F.lit(" a"), F.col("p_size").cast("string")), plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))
    raw = F.concat(F.lit("\u3000\u200b"), F.replace(wide, F.lit(" "), F.lit("\u3000 \u200d")), F.lit("\u212b\ufeff\u00a0"))
    return table(spark, d, "part").select("p_partkey", I.nickname_key(raw).alias("key"))


@query("f22_nickname_error", f"""SELECT p_partkey, CASE WHEN key = '' THEN 'NICK_REQUIRED' WHEN length(key) NOT BETWEEN 2 AND 12 THEN 'NICK_INVALID' WHEN NOT regexp_matches(key, '^[a-z0-9_ ]+$') THEN 'NICK_INVALID'
WHEN regexp_matches(key, 'admin|mod|system|agent') THEN 'NICK_RESERVED' END AS error FROM (SELECT p_partkey, lower(regexp_replace(trim({_RAW}), ' +', ' ', 'g')) AS key FROM part)""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", I.nickname_error(I.nickname_key(_raw())).alias("error"))


@query("f23_username_error", "SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'REQUIRED' WHEN NOT regexp_matches(trim(p_name), '^[a-zA-Z0-9_]{3,20}$') THEN 'INVALID' END AS username, CASE WHEN length(p_type) < 8 THEN 'SHORT' WHEN NOT regexp_matches(p_type || p_size, '[0-9]') THEN 'WEAK' END AS password FROM part")
def _(spark, d):
    password = F.when(F.length("p_type") < 8, F.col("p_type")).otherwise(F.concat("p_type", F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", I.username_error(F.col("p_name")).alias("username"), I.password_error(password).alias("password"))


@query("f25_viewer_key", "SELECT event_id, sha256(CASE WHEN user_id % 2 = 0 THEN 'u:' || user_id ELSE 'a:' || '10.0.0.' || user_id || '|' || event_type || '|salt' END) AS viewer FROM events")
def _(spark, d):
    user = F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
    key = I.viewer_key(user, F.concat(F.lit("10.0.0."), "user_id"), F.col("event_type"), "salt")
    return table(spark, d, "events").select("event_id", key.alias("viewer"))


_BLOB = [f"'{''.join(f'{chr(92)}x{b:02X}' for b in pad)}'::BLOB" for pad in I.hmac_pads("secret")]


@query("f26_signature", f"SELECT c_custkey, signature, left(signature, 1) IN ('0', '1') AS ok FROM (SELECT c_custkey, sha256({_BLOB[1]} || unhex(sha256({_BLOB[0]} || encode(c_name)))) AS signature FROM customer)")
def _(spark, d):
    sign = I.signature(F.col("c_name"), "secret")
    return table(spark, d, "customer").select("c_custkey", sign.alias("signature")).withColumn("ok", I.leading_zero_bits(F.col("signature"), 3))


@query("f26_zero_bits", "SELECT c_custkey, left(sha256(c_name), 2) IN ('00', '01', '02', '03', '04', '05', '06', '07') AS ok FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", I.leading_zero_bits(F.sha2("c_name", 256), 5).alias("ok"))


@query("f27_mask_token", "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN 'Customer#' ELSE left(c_name, 6) END || '****' || right(c_name, 4) AS token, left(c_name, 6) || '****' || right(c_name, 4) AS secret FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", I.mask_token(F.col("c_name"), "Customer#").alias("token"), I.mask_secret(F.col("c_name")).alias("secret"))


@query("f28_recovery_code", """SELECT c_custkey, array_to_string(regexp_extract_all(upper(code), '.{1,4}'), '-') = upper(shown) AS same, shown, sha256(code || ':' || c_mktsegment) AS hashed
FROM (SELECT *, lower(regexp_replace(c_name, '[^a-fA-F0-9]', '', 'g')) AS code, array_to_string(regexp_extract_all(lower(regexp_replace(c_name, '[^a-fA-F0-9]', '', 'g')), '.{1,4}'), '-') AS shown FROM customer)""")
def _(spark, d):
    name, shown = F.col("c_name"), I.recovery_code_shown(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", (F.replace(shown, F.lit("-")) == I.recovery_code(name)).alias("same"), shown.alias("shown"), I.recovery_code_hash(name, F.col("c_mktsegment")).alias("hashed"))


@query("f30_strip_nul", "SELECT c_custkey, '<' || left(c_name, 4) || substr(c_name, 5) || '>' AS name, length(c_name) + 3 AS dirty FROM customer")
def _(spark, d):
    nul = F.lit("\0")
    dirty = F.concat(nul, F.left("c_name", F.lit(4)), nul, nul, F.expr("substr(c_name, 5)"))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("<"), S.strip_nul(dirty), F.lit(">")).alias("name"), F.length(dirty).cast("long").alias("dirty"))


@query("f31_client_ip", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '10.1.' || (event_id % 7) || '.9' WHEN event_id % 5 = 1 THEN '10.2.3.' || (user_id % 200) WHEN event_id % 5 = 2 THEN 'fe80::' || user_id END AS ip FROM events""")
def _(spark, d):
    k, user = F.col("event_id") % 5, F.col("user_id")
    direct = F.when(k == 0, F.concat(F.lit("::ffff:10.1."), (F.col("event_id") % 7).cast("string"), F.lit(".9")))
    forwarded = F.when(k == 1, F.concat(F.lit(" 10.2.3."), (user % 200).cast("string"), F.lit(" , 10.9.9.9"))).when(k == 3, "nowhere")
    real = F.when(k == 2, F.concat(F.lit("fe80::"), user.cast("string"))).when(k == 3, "1.1.1.1")
    return table(spark, d, "events").select("event_id", I.client_ip(direct, forwarded, real).alias("ip"))


@query("f32_route_param", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS key FROM part")
def _(spark, d):
    bad = F.element_at(F.array(F.lit(" "), F.lit("undefined"), F.lit(" null ")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.route_param(F.when(F.col("p_partkey") % 4 == 0, bad).otherwise(F.col("p_name"))).alias("key"))


_LEGACY = {"FURNITURE": "home", "HOUSEHOLD": "home"}


@query("j10_slug_join", "SELECT slug, count(*) AS n FROM (SELECT CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'home' ELSE c_mktsegment END AS slug FROM customer) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy(I.canonical_slug(F.col("c_mktsegment"), _LEGACY).alias("slug")).agg(F.count("*").alias("n"))


@query("p22_active_tokens", f"SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_acctbal >= 0 AND (o_orderdate > {NOW} - INTERVAL 9000 DAY)")
def _(spark, d):
    live = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    own = table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > now() - F.expr("INTERVAL 9000 DAYS")))
    return own.join(live, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"))


@query("p23_clock_skew", f"SELECT event_id FROM events WHERE abs(epoch_ms(ts) - epoch_ms({NOW})) <= 3600000")
def _(spark, d):
    apart = F.timestamp_diff("MILLISECOND", now(), F.col("ts"))
    return table(spark, d, "events").where(F.abs(apart) <= 3_600_000).select("event_id")


@query("x01_unique_check", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return W.violations(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@query("x02_foreign_key_check", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 20)")
def _(spark, d):
    parents = table(spark, d, "customer").where("c_nationkey < 20")
    return W.missing_parents(table(spark, d, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey")
