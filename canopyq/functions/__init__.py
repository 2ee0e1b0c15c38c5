"""functions of the drill-down engine."""
