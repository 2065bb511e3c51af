"""Operators a training-data pipeline needs, as Spark jobs over documents,
conversations and embeddings. Each module holds one operator; ``queries``
registers the contract queries. Nothing outside this package imports it."""
