"""All registered queries."""

from . import alerting, evaluation, files, investigation, modelling, recordings, spatial, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
