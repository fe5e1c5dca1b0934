"""Registered queries. Importing the package registers all of them."""

from kinetrail.plans import assembled, catalog, families, features, ingest, pair_families, windows  # noqa: F401
