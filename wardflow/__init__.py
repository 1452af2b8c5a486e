"""Network-flow intrusion analytics and ML-corpus auditing as Spark DataFrame operators."""

__version__ = "0.1.0"
