"""strandloom: a Spark-first engine for variant annotation tables and the data preparation around them."""

__version__ = "0.1.0"
