"""Parts of addresses, masking of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_parts(url: Column) -> dict[str, Column]:
    """host, origin, path, query and hash; '' where there is none."""
    safe = F.coalesce(url, F.lit(""))
    part = lambda pattern: F.regexp_extract(safe, pattern, 1)
    return {
        "host": part(r"^https?://([^/?#]+)"),
        "origin": part(r"^(https?://[^/?#]+)"),
        "path": part(r"^https?://[^/?#]+([^?#]*)"),
        "query": part(r"^[^?#]*\?([^#]*)"),
        "hash": part(r"#(.*)$"),
    }


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    return (strip_www(a) == strip_www(b)) & (a != "")


def strip_trailing_slash(path: Column) -> Column:
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))


def mask(text: Column, keep: int = 4) -> Column:
    """The first characters as they are, later word characters as stars."""
    return F.concat(F.substring(text, 1, keep), F.regexp_replace(F.substr(text, F.lit(keep + 1)), r"\w", "*"))
