"""All registered queries (importing the query modules fills the registry)."""

from semcode.plans.registry import QUERIES, ORACLE  # noqa: F401
from semcode.plans import q_match, q_evaluate, q_prep, q_sample, q_encode, q_cluster, q_topics, q_stream, q_sinks  # noqa: F401
