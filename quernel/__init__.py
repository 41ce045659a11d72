"""A PySpark-native engine: columnar scans and sinks, nested assembly, keyed tables, templates."""
