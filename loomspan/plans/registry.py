"""All registered queries outside loomspan.llm, and their SQL."""

from __future__ import annotations

from loomspan.plans import code_queries, corpus_queries, retrieval_queries, stream_queries

QUERIES: dict = {**retrieval_queries.QUERIES, **corpus_queries.QUERIES, **code_queries.QUERIES, **stream_queries.QUERIES}
ORACLES: dict[str, str] = {**retrieval_queries.ORACLES, **corpus_queries.ORACLES, **code_queries.ORACLES, **stream_queries.ORACLES}
