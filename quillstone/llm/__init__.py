"""Operators of a training-data pipeline.

Nothing else in the package imports this subpackage; its queries are added by
the driver entry only where it can be imported.
"""
