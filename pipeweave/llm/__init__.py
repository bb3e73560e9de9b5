"""Operators for preparing large text corpora for language-model training.

Nothing else in ``pipeweave`` imports this subpackage; it can be removed without
touching the rest of the engine.
"""
