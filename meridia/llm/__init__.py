"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it, so it can be removed without touching
the geospatial feature engine in the rest of ``meridia``.
"""
