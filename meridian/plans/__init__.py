"""The registered queries of the catalogue engine."""

from . import curves, flows, groups, joins, lightcurves, more, scalars  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
