"""All queries over the given tables and the SQL each is compared with."""

from vigia.plans import catalogue, deliveries, oracle, oracle_deliveries

QUERIES = {**catalogue.QUERIES, **deliveries.QUERIES}
ORACLE = {**oracle.ORACLE, **oracle_deliveries.ORACLE}
