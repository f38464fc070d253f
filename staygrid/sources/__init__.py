"""Reading, ingesting, bucketing and exporting tables."""
