"""String-structure analytics on Spark."""
