"""helixframe: a Spark-first analytics engine for nucleic-acid structure-probing tables."""

__version__ = "0.1.0"
