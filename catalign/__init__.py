"""Catalogue analytics for digital assets, written as Spark DataFrame operators."""
