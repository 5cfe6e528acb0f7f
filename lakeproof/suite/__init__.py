from . import landing, lineage, merge, models, proof, quality, scalars  # noqa: F401
from .base import QUERIES, SQL, table  # noqa: F401
