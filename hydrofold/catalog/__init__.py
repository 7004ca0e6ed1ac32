"""All registered queries; importing this package fills the registry."""

from . import features, imputation, ingest, maps, neighbours, plans, quality  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
