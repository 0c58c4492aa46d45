"""Discovery of dynamically loaded scripts in captured web sites, as Spark DataFrame operations."""
