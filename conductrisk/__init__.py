"""conductrisk: behaviour-risk analytics over activity logs, written for Spark."""

__version__ = "0.1.0"
