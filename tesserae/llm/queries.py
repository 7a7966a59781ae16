"""All queries of the corpus operators, and the SQL of those that SQL can express."""

from tesserae.llm import decontam, divergence, embeddings, fim, html, line_dedup, lm, near_dedup, packing, pii, secrets, token_counts, toxicity

MODULES = (toxicity, decontam, near_dedup, line_dedup, pii, embeddings, html, packing, secrets, token_counts, fim, divergence, lm)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
