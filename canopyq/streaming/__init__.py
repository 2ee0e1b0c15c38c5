"""streaming of the drill-down engine."""
