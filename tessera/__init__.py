"""tessera: a Spark-native analytics engine for governed inventories."""
