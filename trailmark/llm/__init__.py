"""Operators for preparing language-model training data.

Every operator takes and returns Spark DataFrames.  ``queries`` registers the
contract queries; nothing outside this subpackage imports it.
"""
