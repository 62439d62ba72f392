"""otflow: industrial network provenance and corpus preparation on PySpark."""
