"""The registered queries: each operator run over the driver tables, with its SQL."""

from catalogue import (  # noqa: F401  (importing registers the queries)
    aggregates, findings, ordering, profiles, questions, search, selection, sourcing,
    streams, usage,
)
from catalogue.tables import QUERIES, SQL  # noqa: F401
