"""Queries over the test tables, one or more for each operator."""

from . import catalogue, directory, entities, landing, models, profiles, relational, series, spatial, streams, texts, upkeep  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
