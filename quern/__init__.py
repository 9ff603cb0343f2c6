"""quern: a Spark-native engine for longitudinal analytics, retrieval evaluation and scoring."""
