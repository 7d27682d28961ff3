"""Every query of the library but those of the text operators."""

from lodestone.plans import audit, blockmodel, contract, diagnostics, evaluation, inversion, mining, spatial, stations, streams  # noqa: F401
from lodestone.plans.registry import QUERIES, SQL  # noqa: F401
