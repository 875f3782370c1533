"""Reading, projecting, exporting and writing the canonical tables."""
