"""Clinical time-series analytics as lazy Spark DataFrame operators.

Tables follow a few fixed shapes (see ``staygrid.schema``): item-long rows
``(id, t, item, value, unit)``, time series ``(id, t, value)``, windows
``(id, start, end, value)``. Times are whole seconds since admission.
"""

from staygrid.schema import Table

__all__ = ["Table"]
__version__ = "0.1.0"
