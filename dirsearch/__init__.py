"""dirsearch: directory building and search as Spark DataFrame plans.

Main entry points::

    from dirsearch import search, cascade, parse_pages, knn_exact, knn_lsh, batch_search
"""

from dirsearch.operators.criteria import search
from dirsearch.operators.knn import knn_exact, knn_lsh, knn_single
from dirsearch.operators.querylog import batch_search, extract_criteria, route_tag, split_clauses
from dirsearch.plans.cascade import cascade
from dirsearch.plans.ingest import parse_pages

__all__ = ["search", "knn_exact", "knn_lsh", "knn_single", "batch_search", "extract_criteria", "route_tag",
           "split_clauses", "cascade", "parse_pages"]
__version__ = "0.1.0"
