"""All queries of the library but those of its optional subpackage."""

from spoolworks.plans import catalog_queries, edge_queries, lookup_queries, media_queries, rule_queries, text_queries

PARTS = (catalog_queries, media_queries, text_queries, lookup_queries, rule_queries, edge_queries)
QUERIES = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: q for part in PARTS for name, q in part.ORACLE_SQL.items()}
