"""sievelight: full-text search, faceting and corpus preparation as Spark plans."""
