"""Queries by name, each with its SQL where SQL can express it."""

from docloom.plans import audit_queries, continuation_queries, encoding_queries, evidence_queries, inventory_queries, label_queries, reading_queries, reading_state_queries, relational_queries, retrieval_queries, rules_queries, search_queries, session_queries, structure_queries, subset_queries, table_queries, validation_queries  # noqa: F401
from docloom.plans.registry import QUERIES, SQL  # noqa: F401
