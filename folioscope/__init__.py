"""Document analytics on Spark: extraction to tables, computation over them, rendering."""
