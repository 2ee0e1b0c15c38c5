"""operators of the drill-down engine."""
