"""Every operator as a query over the driver's tables, with a twin in SQL for an independent engine."""
