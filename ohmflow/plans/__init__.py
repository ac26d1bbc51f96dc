"""Named end-to-end plans (queries) over the driver tables, each paired with an
independent SQL formulation used as a correctness oracle."""

from .registry import ORACLE, QUERIES  # noqa: F401
from . import catalog, modeling  # noqa: F401  (registers the queries)
