"""Formula planning and the registered queries."""
