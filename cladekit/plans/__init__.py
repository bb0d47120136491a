"""The registered queries, grouped by subject."""

from importlib import import_module

SUBJECTS = (
    "relational", "genomes", "statistics", "evaluation", "trees", "scoring", "storage", "streams", "whole_jobs",
    "parts",
)


def load():
    """Import every subject once; returns the queries and their SQL."""
    for subject in SUBJECTS:
        import_module(f".{subject}", __name__)
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
