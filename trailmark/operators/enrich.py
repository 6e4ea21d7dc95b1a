"""Enrichment of raw events: referrers, campaigns, user agents, bots, addresses, times.

Lookups run on distinct keys and are joined back, so each distinct user agent,
host or address is looked at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import same_domain, strip_www, url_parts

#: A small seed of known referrers (host, name, type).
REFERRERS = [
    ("google.com", "Google", "search"),
    ("bing.com", "Bing", "search"),
    ("duckduckgo.com", "DuckDuckGo", "search"),
    ("facebook.com", "Facebook", "social"),
    ("reddit.com", "Reddit", "social"),
    ("x.com", "X", "social"),
    ("linkedin.com", "LinkedIn", "social"),
    ("github.com", "GitHub", "tech"),
    ("news.ycombinator.com", "Hacker News", "social"),
    ("youtube.com", "YouTube", "video"),
]


def seed_referrers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERRERS, "host string, name string, type string")


def classify_referrers(rows: DataFrame, known: DataFrame, host: str = "referrer") -> DataFrame:
    """Adds referrer_name and referrer_type by host, with or without www; of known rows for one host the least counts.

    Rows meet the known hosts directly: Spark broadcasts those if they are small.  Empty hosts become null first, so
    they meet nothing and gather in no task.
    """
    one = lambda key, to: known.groupBy(key.alias(to)).agg(F.min(F.struct("name", "type")).alias(f"{to}_hit"))
    keyed = rows.withColumn("_host", F.nullif(F.lower(F.col(host)), F.lit(""))).withColumn("_bare", strip_www(F.col("_host")))
    found = keyed.join(one(F.col("host"), "_host"), "_host", "left").join(one(strip_www(F.col("host")), "_bare"), "_bare", "left")
    told = lambda field: F.coalesce(f"_host_hit.{field}", f"_bare_hit.{field}", F.lit(""))
    return found.select(*[F.col(c) for c in rows.columns], told("name").alias("referrer_name"), told("type").alias("referrer_type"))


def campaign_source(rows: DataFrame, known: DataFrame, properties: str = "properties") -> DataFrame:
    """Adds campaign_name and campaign_type from utm_source, ref or utm_referrer.

    A source matches by host, by host with .com added, or by name; an unknown one
    stands for itself.
    """
    said = lambda k: F.nullif(F.lower(F.element_at(F.col(properties), f"__query.{k}")), F.lit(""))
    source = F.coalesce(said("utm_source"), said("ref"), said("utm_referrer"))
    keys = known.select(F.explode(F.array_distinct(F.array(F.lower("host"), F.regexp_replace(F.lower("host"), r"\.com$", ""), F.lower("name")))).alias("_source"), F.col("name").alias("_name"), F.col("type").alias("_type"))
    keys = keys.groupBy("_source").agg(F.min(F.struct("_name", "_type")).alias("_hit"))
    return rows.withColumn("_source", source).join(keys, "_source", "left").select(
        *rows.columns,
        F.coalesce("_hit._name", "_source", F.lit("")).alias("campaign_name"),
        F.coalesce("_hit._type", F.lit("")).alias("campaign_type"),
    )


def drop_self_referrals(rows: DataFrame, page_host: Column, referrer: str = "referrer") -> DataFrame:
    return rows.withColumn(referrer, F.when(same_domain(F.col(referrer), page_host), "").otherwise(F.col(referrer)))


def parse_user_agent(ua: Column) -> dict[str, Column]:
    """os, browser, their versions, device, brand, model and is_server by a reduced set of rules."""
    has = lambda pattern: ua.rlike(f"(?i){pattern}")
    server = ua.isNull() | (ua == "") | has(r"^(curl|wget|python|go-http|node|axios|okhttp|java|ruby|php|postman)")
    os = (
        F.when(server, "").when(has("iphone|ipad|ipod"), "iOS").when(has("android"), "Android").when(has("windows"), "Windows").when(has("mac os x|macintosh"), "macOS")
        .when(has("cros"), "Chrome OS").when(has("linux"), "Linux").otherwise("")
    )
    browser = (
        F.when(server, "").when(has(r"edg(e|a|ios)?/"), "Edge").when(has(r"opr/|opera"), "Opera").when(has("samsungbrowser"), "Samsung Internet").when(has("firefox|fxios"), "Firefox")
        .when(has("chrome|crios"), "Chrome").when(has("safari"), "Safari").otherwise("")
    )
    tablet = has("ipad|tablet|kindle|silk") | (has("android") & ~has("mobile"))
    device = F.when(server, "server").when(tablet, "tablet").when(has("mobi|iphone|ipod"), "mobile").otherwise("desktop")
    first = lambda pattern: F.regexp_extract(ua, f"(?i){pattern}", 1)
    number = r"(\d+(?:\.\d+)*)"
    os_version = (
        F.when(os == "iOS", F.replace(first(r"os (\d+(?:_\d+)*) like mac"), F.lit("_"), F.lit("."))).when(os == "Android", first("android " + number)).when(os == "Windows", first("windows nt " + number))
        .when(os == "macOS", F.replace(first(r"mac os x (\d+(?:[_.]\d+)*)"), F.lit("_"), F.lit("."))).otherwise("")
    )
    marks = {"Edge": "edg(?:e|a|ios)?/", "Opera": "(?:opr|opera)/", "Samsung Internet": "samsungbrowser/", "Firefox": "(?:firefox|fxios)/", "Chrome": "(?:chrome|crios)/", "Safari": "version/"}
    browser_version = F.lit("")
    for name, mark in marks.items():
        browser_version = F.when(browser == name, first(mark + number)).otherwise(browser_version)
    apple = first("(iphone|ipad|ipod|macintosh)")
    galaxy, pixel = first(r"\b(sm-[a-z0-9]+)"), first(r"\b(pixel [a-z0-9 ]*?)(?: build|[;)])")
    brand = F.when(server, "").when(apple != "", "Apple").when(galaxy != "", "Samsung").when(pixel != "", "Google").when(has(r"\b(redmi|xiaomi|mi )"), "Xiaomi").when(has("huawei"), "Huawei").otherwise("")
    model = F.when(server, "").when(apple != "", apple).when(galaxy != "", galaxy).otherwise(pixel)
    return {
        "os": os, "os_version": os_version, "browser": browser, "browser_version": browser_version, "device": device, "brand": brand, "model": model, "is_server": server,
    }


#: Columns and the properties that override them.
OVERRIDES = {
    "os": "__os", "os_version": "__osVersion", "browser": "__browser", "browser_version": "__browserVersion", "device": "__device", "brand": "__brand", "model": "__model",
}


def enrich_user_agents(rows: DataFrame, ua: str = "user_agent", properties: str | None = "properties") -> DataFrame:
    """Adds what a user agent tells; properties such as ``__os`` and ``__osVersion`` override it (``OVERRIDES``)."""
    distinct = rows.select(F.col(ua).alias("_ua")).distinct()
    parsed = distinct.select("_ua", *[c.alias(n) for n, c in parse_user_agent(F.col("_ua")).items()])
    out = rows.join(parsed, F.col(ua).eqNullSafe(F.col("_ua")), "left").drop("_ua")
    if properties:
        told = {name: F.coalesce(F.nullif(F.element_at(F.col(properties), key), F.lit("")), F.col(name)) for name, key in OVERRIDES.items()}
        out = out.withColumns(told)
    return out


GRAM = 3


def _grams(told: Column) -> Column:
    """All pieces of at most ``GRAM`` characters, the empty one included."""
    pieces = [F.when(F.length(told) >= n, F.transform(F.sequence(F.lit(1), F.length(told) - n + 1), lambda i: F.substring(told, i, F.lit(n)))) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *[F.coalesce(p, F.array().cast("array<string>")) for p in pieces])))


def _first_contained(agents: DataFrame, rules: DataFrame) -> DataFrame:
    """_ua and _bot: the first rule whose text an agent holds.

    A rule meets only agents that hold its rarest piece of ``GRAM`` characters (all of it, if it is shorter); a rule
    with a piece that no agent holds meets none.
    """
    held = agents.select("_ua", F.explode(_grams(F.col("_ua"))).alias("gram"))
    own = F.filter(_grams(F.col("includes")), lambda g: F.length(g) == F.least(F.lit(GRAM), F.length("includes")))
    asked = rules.select("position", "name", "type", "includes", F.explode(own).alias("gram"))
    known = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("agents"))
    weighed = asked.join(known, "gram", "left").withColumn("agents", F.coalesce("agents", F.lit(0)))
    rarest = weighed.groupBy("position", "name", "type", "includes").agg(F.min(F.struct("agents", "gram")).alias("_key"))
    keyed = rarest.filter("_key.agents > 0").select("position", "name", "type", "includes", F.col("_key.gram").alias("gram"))
    met = held.join(keyed, "gram").filter(F.col("_ua").contains(F.col("includes")))
    return met.groupBy("_ua").agg(F.min(F.struct("position", "name", "type")).alias("_bot"))


def _first_matching(agents: DataFrame, rules: DataFrame) -> DataFrame:
    """_ua and _bot: the first rule whose pattern an agent matches; patterns are tried one by one only where any of them matches.

    Patterns that refer to groups by number or name can't be joined into one; then all agents are tried.
    """
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("position", "name", "type", "regex"))).alias("all"))  # one row
    apart = F.exists("all", lambda r: r["regex"].rlike(r"\\[1-9k]|\(\?<[A-Za-z]"))
    either = F.when(apart, F.lit("")).otherwise(F.array_join(F.transform("all", lambda r: F.concat(F.lit("(?:"), r["regex"], F.lit(")"))), "|"))
    some = agents.filter(F.regexp_like("_ua", listed.select(either.alias("either")).scalar()))
    tried = some.withColumn("_all", listed.scalar()).select("_ua", F.explode("_all").alias("_rule")).filter(F.regexp_like("_ua", F.col("_rule.regex")))
    return tried.groupBy("_ua").agg(F.min(F.struct("_rule.position", "_rule.name", "_rule.type")).alias("_bot"))


def classify_bots(rows: DataFrame, rules: DataFrame, ua: str = "user_agent") -> DataFrame:
    """Adds bot_name and bot_type; ``rules`` has position, name, type, includes and regex.

    Substring rules come before regular expressions, then the smaller position
    wins.  Rules are matched against distinct user agents only; all patterns are one row.
    """
    agents = rows.select(F.col(ua).alias("_ua")).filter(F.col("_ua").isNotNull()).distinct()
    texts = _first_contained(agents, rules.filter("includes IS NOT NULL"))
    rest = agents.join(texts, "_ua", "left_anti")
    found = texts.unionByName(_first_matching(rest, rules.filter("includes IS NULL AND regex IS NOT NULL")))
    return rows.join(found, F.col(ua) == F.col("_ua"), "left").select(*rows.columns, F.col("_bot.name").alias("bot_name"), F.col("_bot.type").alias("bot_type"))


def split_bots(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of people, and bot events that carry a path."""
    bot = F.col("bot_name").isNotNull()
    return classified.filter(~bot).drop("bot_name", "bot_type"), classified.filter(bot & (F.coalesce("path", F.lit("")) != ""))


def plain_ip(ip: Column) -> Column:
    """The address without the prefix of IPv4 addresses in IPv6 form."""
    return F.regexp_replace(F.lower(F.trim(ip)), r"^::ffff:(?=\d+\.)", "")


def ip_bits(ip: Column) -> Column:
    """'4' or '6' and the bits of an address, as text; null if it is none."""
    ip = plain_ip(ip)
    bits = lambda parts, base, width: F.array_join(F.transform(parts, lambda x: F.lpad(F.conv(x, base, 2), width, "0")), "")
    four = F.split(ip, r"\.")
    sides = F.split(ip, "::")  # what lies before and after the run of zeros, if there is one
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    gap = F.greatest(F.lit(8) - F.size(groups(0)) - F.size(groups(1)), F.lit(0))
    six = F.concat(groups(0), F.when(F.size(sides) == 2, F.array_repeat(F.lit("0"), gap)).otherwise(F.array().cast("array<string>")), groups(1))
    is_six = ip.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & ~ip.rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$") & (F.size(six) == 8)
    is_four = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(four, lambda x: x.try_cast("int") <= 255)
    return F.when(is_four, F.concat(F.lit("4"), bits(four, 10, 8))).when(is_six, F.concat(F.lit("6"), bits(six, 16, 16)))


#: Ranges of addresses that belong to no place.
PRIVATE = r"^(0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|::1?$)"


def is_public(ip: Column) -> Column:
    return ip_bits(ip).isNotNull() & ~plain_ip(ip).rlike(PRIVATE)


def client_ip(headers: Sequence[str]) -> Column:
    """The first valid public address in ordered header columns, each a comma-separated list."""
    first = lambda h: F.get(F.filter(F.transform(F.split(F.coalesce(F.col(h), F.lit("")), ","), lambda x: F.trim(x)), is_public), 0)
    return F.coalesce(*[first(h) for h in headers])


def locate(rows: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Adds what CIDR ranges of any length (network, bits, country, city, …) say of addresses; '' or null where none does.

    Addresses and ranges of both kinds (IPv4, IPv6) meet under the range's first bits: one equi-join for all lengths
    that occur, the longest match winning.
    """
    told = [c for c in ranges.columns if c not in ("network", "bits")]
    first = lambda text: F.substr(text, F.lit(1), F.col("bits") + 1)
    kind = lambda text: F.substring(text, 1, 1).alias("_kind")
    network = ip_bits(F.col("network"))
    ranged = ranges.select("bits", first(network).alias("_key"), kind(network), *told)
    used = ranged.select("_kind", "bits").distinct()
    addresses = rows.select(F.col(ip).alias("_ip")).filter(is_public(F.col("_ip"))).distinct()
    known = addresses.select("_ip", ip_bits(F.col("_ip")).alias("_bits"), kind(ip_bits(F.col("_ip"))))
    probes = known.join(F.broadcast(used), "_kind").select("_ip", first(F.col("_bits")).alias("_key"))  # 33 + 129 lengths at most
    found = probes.join(ranged, "_key").groupBy("_ip").agg(F.max_by(F.struct(*told), "bits").alias("_at"))
    return rows.join(found, F.col(ip) == F.col("_ip"), "left").select(
        *rows.columns, *[(F.coalesce(f"_at.{c}", F.lit("")) if of == "string" else F.col(f"_at.{c}")).alias(c) for c, of in ranges.dtypes if c in told]
    )


def with_visitor(rows: DataFrame, pepper: str) -> DataFrame:
    """Adds visitor, which stays the same when salts change; keep it in state only, for as long as a session lives, never in a table."""
    return rows.withColumn("visitor", F.sha2(F.concat_ws(":", "user_agent", "ip", "project_id", F.lit(pepper)), 256))


def device_ids(rows: DataFrame, salts: DataFrame) -> DataFrame:
    """Adds device_id and previous_device_id by the salts of the day and the day before (day, salt)."""
    order = Window.orderBy("day")  # one row a day
    both = salts.withColumn("_before", F.lag("salt").over(order)).withColumnRenamed("salt", "_now")
    digest = lambda salt: F.substring(F.sha2(F.concat_ws(":", "user_agent", "ip", "project_id", salt), 256), 1, 32)
    joined = rows.withColumn("day", F.to_date("created_at")).join(both, "day", "left")
    return joined.select(*rows.columns, digest("_now").alias("device_id"), F.when(F.col("_before").isNotNull(), digest("_before")).otherwise("").alias("previous_device_id"))


def event_time(sent: Column, received: Column) -> dict[str, Column]:
    """Client times more than a minute ahead, or none, become the server's; those over 15 minutes old are past."""
    micros = F.unix_micros(sent) - F.unix_micros(received)
    bad = sent.isNull() | (micros > 60_000_000)
    return {"created_at": F.when(bad, received).otherwise(sent), "is_past": ~bad & (micros < -900_000_000)}


def parse_revenue(value: Column) -> Column:
    return F.coalesce(value.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


#: Property keys that are read and then dropped.
CONSUMED = ("__path", "__referrer", "__timestamp", "__revenue")


def normalize_events(raw: DataFrame) -> DataFrame:
    """Tracked rows (name, created_at, properties map, …) as canonical rows."""
    prop = lambda k: F.coalesce(F.element_at("properties", k), F.lit(""))
    parts = url_parts(prop("__path"))
    query = F.str_to_map(parts["query"], F.lit("&"), F.lit("="))
    added = F.map_filter(F.transform_keys(query, lambda k, v: F.concat(F.lit("__query."), k)), lambda k, v: v.isNotNull() & (v != ""))
    kept = F.map_filter("properties", lambda k, v: ~k.isin(*CONSUMED) & ~k.startswith("__query.") & (v != ""))
    hashed = F.when(parts["hash"] != "", F.create_map(F.lit("__hash"), parts["hash"])).otherwise(F.create_map().cast("map<string,string>"))
    referrer = url_parts(prop("__referrer"))["host"]
    return raw.select(
        *[c for c in raw.columns if c != "properties"],
        F.when(parts["origin"] == "", prop("__path")).otherwise(parts["path"]).alias("path"),
        parts["origin"].alias("origin"),
        F.when(same_domain(referrer, parts["host"]), "").otherwise(referrer).alias("referrer"),
        parse_revenue(prop("__revenue")).alias("revenue"),
        F.map_concat(kept, added, hashed).alias("properties"),
    )
