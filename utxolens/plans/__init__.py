"""The named queries over the given tables."""

from utxolens.plans import cases, evidence, feeds, graph, ingest, ownership, recovery, stores, transactions, typologies  # noqa: F401
from utxolens.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
