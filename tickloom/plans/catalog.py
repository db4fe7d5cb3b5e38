"""All registered queries."""

from tickloom.plans import (  # noqa: F401
    catalog_features,
    catalog_labels,
    catalog_market,
    catalog_text,
    catalog_trades,
)
from tickloom.plans.registry import ORACLES, QUERIES  # noqa: F401
