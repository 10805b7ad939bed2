"""Training-data operators: extraction, deduplication, quality, secrets,
tokenisation, similarity join and mixing, plus their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
