"""Column expressions (JVM-side; no Python row UDFs)."""
