"""The registered queries of the library and their SQL."""

from __future__ import annotations

from tesserae.plans import answers, catalogue, corpus, evaluation, identifiers, identities, importer, lifecycle, profiles, relations, rendered, resolving, search, sources, tables, workflow  # noqa: F401  they add to the catalogue

QUERIES = catalogue.QUERIES
ORACLES = catalogue.ORACLES
