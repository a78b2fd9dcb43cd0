"""Scalar and aggregate column functions; all of them run inside the JVM."""
