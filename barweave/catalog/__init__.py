"""Ready-made queries over the given tables, and the same results in plain SQL."""

from __future__ import annotations


def load_queries() -> dict:
    from barweave.catalog import indicators, learning, streams, trading  # noqa: F401  (they register themselves)
    from barweave.catalog.tables import QUERIES

    return dict(QUERIES)
