"""All queries of the library proper and the SQL they are held against."""

from lodestone.plans import assembly, evaluation, operations, queries, retrieval  # noqa: F401  (they register their queries)
from lodestone.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "bm25_evaluation"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
