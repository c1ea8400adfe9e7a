"""Operations of a large training-data pipeline.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface, the thin ``opN_`` query over the driver's tables and,
where SQL can express it, the DuckDB twin.
"""
