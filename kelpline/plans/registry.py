"""All queries of the library by name, with the SQL that each is held against."""

import kelpline.plans.exports
import kelpline.plans.predicates  # noqa: F401  (both register themselves)
from kelpline.plans import indexes, streams
from kelpline.plans.queries import ORACLE, QUERIES

QUERIES |= streams.QUERIES | indexes.QUERIES
ORACLE |= streams.ORACLE | indexes.ORACLE
