"""Relational operators: as-of selection, interval algebra, ordered scans, ranking, quality."""
