"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from folioloom.plans import documents, lives, pages, previews, tables, workspace

QUERIES = pages.QUERIES | documents.QUERIES | tables.QUERIES | workspace.QUERIES | lives.QUERIES | previews.QUERIES
ORACLES = pages.ORACLES | documents.ORACLES | tables.ORACLES | workspace.ORACLES | lives.ORACLES | previews.ORACLES
