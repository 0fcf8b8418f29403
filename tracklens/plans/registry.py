"""Name -> query callable and name -> SQL of every reference operator group."""

from tracklens.plans import export_queries, interval_queries, mask_queries, scale_queries

QUERIES = interval_queries.QUERIES | mask_queries.QUERIES | export_queries.QUERIES | scale_queries.QUERIES
ORACLE_SQL = interval_queries.ORACLE_SQL | mask_queries.ORACLE_SQL | export_queries.ORACLE_SQL | scale_queries.ORACLE_SQL
