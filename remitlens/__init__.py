"""Denial-risk analytics over large claim tables, written as Spark jobs.

Operators take and return DataFrames. Anything that has to be learned from the
data (a calibrated intercept, a split point, a vocabulary) is a small ``fit``
step that returns plain values; applying it is a narrow column expression.
"""
