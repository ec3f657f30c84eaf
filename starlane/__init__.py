"""starlane: Spark-native analytics for activity, identity and infrastructure data of a decentralised network."""
