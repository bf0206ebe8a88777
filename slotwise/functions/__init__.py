"""Scalar functions as Column builders; all of them run in the JVM."""
