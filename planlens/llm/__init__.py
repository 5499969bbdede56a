"""Operators for training-data pipelines; nothing else in planlens imports this."""
