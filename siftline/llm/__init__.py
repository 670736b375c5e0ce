"""Operators for training-data pipelines: one module for each operator, registered in :mod:`siftline.llm.queries`."""
