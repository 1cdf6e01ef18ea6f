"""Registered queries with the same questions in SQL."""

from trackledger.plans import documents, feeds, records, storage, streams

ALL_QUERIES = {**feeds.QUERIES, **documents.QUERIES, **records.QUERIES, **streams.QUERIES, **storage.QUERIES}
ALL_ORACLES = {**feeds.ORACLES, **documents.ORACLES, **records.ORACLES, **streams.ORACLES, **storage.ORACLES}
