"""All registered queries over the driver's tables and the SQL that must give the same rows."""

from . import assembly_queries, decision_queries, record_queries, report_queries, retrieval_queries, stream_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "assembly_queries", "decision_queries", "record_queries", "report_queries", "retrieval_queries", "stream_queries", "text_queries"]
