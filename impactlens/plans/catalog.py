"""Every query of the package but those of the training-data operators, and their SQL."""

from impactlens.plans import code_queries, command_queries, lookup_queries, operator_queries, path_queries, project_queries, queries, report_queries  # noqa: F401
from impactlens.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
