"""Operators for training-data pipelines over text, vectors and web archives.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` list
what it adds to the driver contract.
"""
