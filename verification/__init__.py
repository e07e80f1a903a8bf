"""Every operator as a query over the driver's tables, with its DuckDB twin where SQL can say it."""
