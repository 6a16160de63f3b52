"""A PySpark engine for static-analysis, graph and privacy-evidence queries."""
