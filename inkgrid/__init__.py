"""inkgrid: positioned words of labour documents to audited tables, on Spark."""
