"""groundphrase: corpus-grounded phrase retrieval, decision and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
