"""All queries of the analytics engine and their SQL twins."""

from . import charting, filtering, ingest, product, streaming  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
