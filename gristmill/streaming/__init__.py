"""Streams: row-level operators run on streaming DataFrames as they are; here are a routed sink and counts over time.

Select, predicates, cleaning steps, casts, spreadsheet functions, row rules,
masks, routing and splitting by row rules, and membership filters with a static
reference need nothing of their own.  Operators over groups, orders or whole
tables need a batch.
"""
