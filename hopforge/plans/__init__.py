"""How operators are put together: lineage, fixture graphs, jobs and the query catalogue."""
