"""heliotrope: a Spark-native engine for metrics, logs and traces."""
