"""Registered queries over the supplied tables, each with its SQL twin."""

from siftwork.plans.catalog import all_oracles, all_queries  # noqa: F401
