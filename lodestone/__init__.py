"""lodestone: a Spark-first rule, query and training-data engine."""
