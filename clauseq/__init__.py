"""clauseq: search, citation graphs, rules and registers over long numbered documents, as Spark jobs."""
