"""Session-ledger analytics on Spark."""
