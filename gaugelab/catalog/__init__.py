"""All registered queries."""

from gaugelab.catalog import audit, modelling, scoring, stores  # noqa: F401
from gaugelab.catalog.base import ORACLES, QUERIES  # noqa: F401
