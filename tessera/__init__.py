"""A relational SQL engine on PySpark, and operators beside it."""
