"""lodeframe: byte, bit, numeric, sequence, interval, graph, colour and signal computations as Spark DataFrame operations."""

__version__ = "0.1.0"
