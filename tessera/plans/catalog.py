"""All registered queries: importing this module imports every module of queries."""

from tessera.plans import audit, evaluation, evidence, explore, fields, formats, gates, network, partition, ranking, similarity  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
