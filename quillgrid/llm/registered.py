"""The subpackage's queries and their SQL."""

from . import fingerprints, mixing, ngram_join, packing, pii, secret_scan, sharding, token_counts, topk, toxicity

_MODULES = (packing, ngram_join, secret_scan, pii, fingerprints, token_counts, sharding, toxicity, topk, mixing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
