"""Registered queries over the driver tables, each with an equivalent SQL text where SQL can say it."""

from checks import claim_queries, source_queries, text_queries  # noqa: F401

QUERY_MODULES = [text_queries, claim_queries, source_queries]
