"""Plans: model build order, query catalog, DuckDB oracle."""
