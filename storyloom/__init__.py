"""News-story analytics on Spark: tables in, tables out."""
