"""Lodestar: dimensional modelling and measures as Spark DataFrame operators."""
