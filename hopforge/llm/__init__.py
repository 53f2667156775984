"""Operators for preparing training text, each usable alone on any DataFrame.

Every module holds one operator; ``catalog`` registers the contract queries.
Nothing outside this subpackage imports it.
"""
