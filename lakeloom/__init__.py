"""lakeloom: DataFrame operators for versioned, content-addressed data and its search, lineage and governance."""
