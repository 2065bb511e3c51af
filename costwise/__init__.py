"""costwise: train, score, decide and explain fraud risk as Spark jobs."""

__version__ = "0.1.0"
