"""Point-in-time claims cohorts, features and capacity rankings as Spark DataFrame plans."""
