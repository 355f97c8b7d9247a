"""Social flare-up analytics expressed as lazy Spark DataFrame functions."""

__version__ = "0.1.0"
