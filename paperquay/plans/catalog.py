"""All registered queries."""

from paperquay.plans import (  # noqa: F401
    contract_queries,
    document_queries,
    export_queries,
    stream_queries,
    text_queries,
)
from paperquay.plans.registry import ORACLE, QUERIES  # noqa: F401
