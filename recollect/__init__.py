"""Spark-native analytics over long-term memory tables: facts, events, scopes, edges and activities."""
