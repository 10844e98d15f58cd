"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface; ``queries.py`` registers the thin
``opN_*`` queries over the driver tables. Nothing outside this subpackage imports it.
"""
