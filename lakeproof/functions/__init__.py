from .scalar import *  # noqa: F401,F403
from .types import control_type, export_type, map_types, struct_type, warehouse_type  # noqa: F401
