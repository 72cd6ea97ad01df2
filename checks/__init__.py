"""The registered queries over the driver's tables, and the same questions in SQL."""
