"""Registered queries: each module maps names to Spark callables and to the SQL that checks them."""
