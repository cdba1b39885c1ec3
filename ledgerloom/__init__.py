"""Payment-ledger analytics on PySpark: parsing, reports and stateful rules as DataFrame operators."""
