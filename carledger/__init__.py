"""Fleet-rental analytics on Spark.

Tables of cars, clients and open orders plus an append-only log of order
changes, turned into set-based DataFrame / Spark SQL / Structured Streaming
jobs: change histories, reports, batch command application, fleet-state
rules, key checks and delimited exports.
"""

from carledger.session import get_session, shared_path

__all__ = ["get_session", "shared_path"]
