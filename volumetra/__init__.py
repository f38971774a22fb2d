"""Volumetra: volume-by-price analytics and signal validation as Spark plans."""

__version__ = "0.1.0"
