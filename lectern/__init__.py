"""lectern: provenance-first text analytics on PySpark."""
