"""Operators of a training-data pipeline. Nothing else in quern imports this subpackage."""
