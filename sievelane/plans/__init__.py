"""The registered queries; importing this package fills the registry."""

from . import calibration, flagship, labelling, ranking, retrieving, storing, texts, variants  # noqa: F401
from .adapters import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
