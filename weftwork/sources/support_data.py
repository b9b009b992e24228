"""Browser support data in its public JSON form as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENTS = "agents map<string, struct<prefix:string, version_list:array<struct<version:string, global_usage:double, release_date:bigint>>>>"
FEATURES = "data map<string, struct<title:string, stats:map<string, map<string, string>>>>"


def agents(data: DataFrame, column: str = "json") -> DataFrame:
    """browser, prefix, version, pos, share, released of every version."""
    each = data.select(F.explode(F.from_json(column, AGENTS).agents).alias("browser", "a"))
    rows = each.select("browser", F.concat(F.lit("-"), "a.prefix", F.lit("-")).alias("prefix"), F.posexplode("a.version_list").alias("pos", "v"))
    return rows.select("browser", "prefix", "v.version", "pos", F.col("v.global_usage").alias("share"), F.col("v.release_date").alias("released"))


def support(data: DataFrame, column: str = "json") -> DataFrame:
    """feature, browser, version, flags of every entry."""
    each = data.select(F.explode(F.from_json(column, FEATURES).data).alias("feature", "f"))
    by_browser = each.select("feature", F.explode("f.stats").alias("browser", "versions"))
    return by_browser.select("feature", "browser", F.explode("versions").alias("version", "flags"))
