"""pagelake: captured web pages to venue tables, as Spark DataFrame operations."""
