"""Operators of a training-data pipeline; ``registry`` names their queries."""
