"""Lodestone: a Spark-native analytics engine for evidence stores."""
