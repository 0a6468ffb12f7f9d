"""Lucidframe: guided modelling, diagnostics and explanation as Spark DataFrame plans."""

__version__ = "0.1.0"
