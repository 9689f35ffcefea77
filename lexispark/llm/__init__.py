"""Operators for large training-data pipelines: one module each, no imports from the rest of the package."""
