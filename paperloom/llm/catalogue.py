"""Queries of the training-data operators, and their SQL where there is one."""

from paperloom.llm import bpe, centroids, extraction, fingerprints, jaccard_join, language_id, licenses, mixing, neighbours, quality, secrets, toxicity, vector_codes

_MODULES = [quality, language_id, licenses, extraction, fingerprints, jaccard_join, neighbours, bpe, mixing, secrets, vector_codes, centroids, toxicity]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
