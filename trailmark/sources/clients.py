"""Where requests come from: user agents and addresses for the canonical tables.

The raw tables know neither; both follow from the user's number by fixed
arithmetic, so that enrichment can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich
from . import tables

AGENTS = (
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8 Build/UD1A) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.6099.43 Mobile Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36 Edg/119.0.2151.58",
    "Mozilla/5.0 (Linux; Android 13; SM-X710) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/23.0 Chrome/115.0.0.0 Safari/537.36",
    "curl/8.4.0",
    "Mozilla/5.0 (compatible; SampleCrawler/2.1; +https://example.org/crawler)",
)
BOT_RULES = [(0, "Sample crawler", "crawler", "SampleCrawler", None), (1, "Anything that crawls", "unknown", None, "(?i)crawl|spider")]
RANGES = [
    ("81.0.0.0", 16, "SE", "Stockholm", "Stockholm", 18.07, 59.33),
    ("81.1.0.0", 16, "DE", "Berlin", "Berlin", 13.4, 52.52),
    ("81.1.64.0", 18, "DE", "Hamburg", "Hamburg", 9.99, 53.55),
    ("80.0.0.0", 5, "FR", "Paris", "Ile-de-France", 2.35, 48.86),
]
RANGE_SCHEMA = "network string, bits int, country string, city string, region string, longitude double, latitude double"


def with_client(rows: DataFrame) -> DataFrame:
    """Adds user_agent and ip by the device's number."""
    n = F.substring("device_id", 2, 20).cast("long")
    part = lambda by, of: F.pmod(F.floor(n / by), F.lit(of)).cast("string")
    agent = F.element_at(F.array(*map(F.lit, AGENTS)), (F.pmod(n, F.lit(len(AGENTS))) + 1).cast("int"))
    ip = F.when(n % 11 == 0, "10.0.0.1").otherwise(F.concat_ws(".", F.lit("81"), part(1, 3), part(2, 128), F.lit("9")))
    return rows.withColumn("user_agent", agent).withColumn("ip", ip)


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, RANGE_SCHEMA)


def bot_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOT_RULES, "position int, name string, type string, includes string, regex string")


def client_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_client(tables.base_events(spark, sf_dir))


def client_sessions(spark: SparkSession, sf_dir: str, known: DataFrame) -> DataFrame:
    """Sessions with all that enrichment says of them."""
    rows = with_client(tables.sessions(spark, sf_dir)).drop("country", "region")
    placed = enrich.locate(enrich.enrich_user_agents(rows, properties=None), ranges(spark))
    return enrich.classify_referrers(placed, known)
