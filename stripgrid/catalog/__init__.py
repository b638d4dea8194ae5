"""Every operator as a query over tables, and the same results in SQL."""
