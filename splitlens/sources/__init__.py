"""Sources and sinks: table loading, parameterised SQL reads, CSV / Parquet / TSV files."""

from splitlens.sources.tables import TABLES, read_table, register_views, sql_read

__all__ = ["TABLES", "read_table", "register_views", "sql_read"]
