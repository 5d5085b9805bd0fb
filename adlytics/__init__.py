"""Spark-native analytics for advertising delivery, conversions and identity."""

from adlytics.params import ConversionPixels, Period
from adlytics.session import configure

__all__ = ["ConversionPixels", "Period", "configure"]
