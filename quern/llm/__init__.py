"""Operators for training-data pipelines.

Nothing outside this folder imports it.  ``quern.llm.registry`` lists the
queries; every operator lives in a module of its own.
"""
