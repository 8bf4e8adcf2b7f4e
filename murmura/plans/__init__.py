"""Query registry: each name with its Spark plan and, where SQL can say it, its oracle."""
