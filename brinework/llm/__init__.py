"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the queries that apply the
operators to the ``documents`` table are listed in :mod:`.queries`.
"""
