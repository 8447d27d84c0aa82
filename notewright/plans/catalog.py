"""All registered queries."""

from notewright.plans import (  # noqa: F401
    catalog_judge,
    catalog_models,
    catalog_notes,
    catalog_split,
    catalog_vectors,
)
from notewright.plans.registry import CATALOG

__all__ = ["CATALOG"]
