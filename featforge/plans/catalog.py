"""All registered queries."""

from . import learning, series, tabular, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
