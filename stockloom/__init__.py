"""stockloom: a PySpark engine for market-inventory snapshots, identity resolution and audits."""
