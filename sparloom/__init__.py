"""sparloom: retrieval, agent-memory and state-cost analytics as Spark DataFrames."""

__version__ = "0.1.0"
