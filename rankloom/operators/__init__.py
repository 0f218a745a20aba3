"""DataFrame -> DataFrame operators (joins, aggregates, windows, encoders)."""
