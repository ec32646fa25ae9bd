"""quire: a Spark-native engine that turns documents into queryable relations."""
