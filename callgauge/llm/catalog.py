"""Imports the modules that register queries."""

from callgauge.llm import audit, jaccard, licences, packing, pages, pieces, quality, repair, search, sharding, simhash, suffixes, toxicity  # noqa: F401
