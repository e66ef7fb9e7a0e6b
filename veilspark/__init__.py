"""veilspark - corpus-scale document cleaning, personal-data registry and redaction on Spark."""

__version__ = "0.1.0"
