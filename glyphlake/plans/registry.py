"""All queries of the image-batch side, by name."""

from __future__ import annotations

from . import image_queries, stream_queries, table_queries

QUERIES: dict = {**image_queries.QUERIES, **table_queries.QUERIES, **stream_queries.QUERIES}
ORACLES: dict = {**image_queries.ORACLES, **table_queries.ORACLES, **stream_queries.ORACLES}
