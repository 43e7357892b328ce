"""All queries of the package in one catalog."""

from __future__ import annotations

from importlib import import_module

from .sqlkit import Catalog

SECTIONS = ("scores", "masks", "rasters", "training", "slides", "pipelines")


def full_catalog() -> Catalog:
    out = Catalog()
    for section in SECTIONS:
        part = import_module(f"{__package__}.{section}").catalog
        for name, fn in part.queries.items():
            out.add(name, fn, part.oracle.get(name))
    return out
