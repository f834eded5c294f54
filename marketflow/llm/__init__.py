"""Operators of a large-scale training-data pipeline (quality, dedup,
decontamination, mixing, sharding, toxicity, personal data, licenses).

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
registered ``opN_<name>`` queries and their SQL.
"""
