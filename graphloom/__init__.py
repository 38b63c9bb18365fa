"""graphloom: a Spark-native engine that builds and queries knowledge graphs from document collections."""
