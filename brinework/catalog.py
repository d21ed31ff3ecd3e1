"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from brinework.queries import ORACLES, QUERIES, datasets, evaluation, forms, relational, retrieval, texts

__all__ = ["ORACLES", "QUERIES", "datasets", "evaluation", "forms", "relational", "retrieval", "texts"]
