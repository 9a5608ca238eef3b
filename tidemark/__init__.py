"""tidemark: Spark-first dataset selection and experiment accounting for data that arrives in groups."""

__version__ = "0.1.0"
