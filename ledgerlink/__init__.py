"""Ledger reconciliation as Spark DataFrame transformations."""
