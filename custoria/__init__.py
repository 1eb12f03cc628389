"""Customer analytics as Spark jobs: features, churn, spend, cohorts, experiments."""
