"""All queries of the core, by name, each over its whole tables, and the SQL of those that SQL can express.

The SQL is written from the definition of each operator, not from its plan, so an error is not shared. Random orders use the SHA-256
hash in both engines; the contract's BLAKE2b hash is held against golden values in the tests.
"""

from __future__ import annotations

from stratawright.queries import build_queries, evaluation_queries, scalar_queries

QUERIES = {**scalar_queries.QUERIES, **build_queries.QUERIES, **evaluation_queries.QUERIES}
SQL = {**scalar_queries.SQL, **build_queries.SQL, **evaluation_queries.SQL}
