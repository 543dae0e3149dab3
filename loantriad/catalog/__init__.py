"""Registered queries with the SQL that checks them."""

from importlib import import_module

GROUPS = ("threeway", "evaluation", "profiling", "ingest", "cleaning", "sampling", "modelling")


def load() -> None:
    for group in GROUPS:
        import_module(f"loantriad.catalog.{group}")
