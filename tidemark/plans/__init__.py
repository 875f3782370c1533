"""Composite plans: cohort, events, features, histories, splits, models, delivery."""
