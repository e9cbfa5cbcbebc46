"""Reading hypergraphs: incidence CSV, JSON-lines records, and groups in any table."""

from weft.sources.groups import from_groups
from weft.sources.incidence import from_incidences, read_csv
from weft.sources.records import parse_records, read_records, records_hypergraph

__all__ = [
    "from_groups",
    "from_incidences",
    "parse_records",
    "read_csv",
    "read_records",
    "records_hypergraph",
]
