"""Composed plans and the registry of named queries."""

from . import (  # noqa: F401  (importing registers the queries)
    block_queries,
    bucket_queries,
    io_queries,
    metric_queries,
    mixture_queries,
    packing_queries,
    prompt_queries,
    schema_queries,
    stream_queries,
    subword_queries,
    token_queries,
    translation_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
