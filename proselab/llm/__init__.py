"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; ``queries`` holds its registered queries and their SQL.
"""

from proselab import blocks  # noqa: F401
