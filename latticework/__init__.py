"""Grid analytics and training-text preparation on Spark."""
