"""All registered queries: importing this module files them."""

from . import batch_queries, control_queries, field_queries, file_queries, form_queries, page_queries, vendor_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
