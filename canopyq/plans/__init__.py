"""plans of the drill-down engine."""
