"""Registered queries: each module pairs Spark plans with their SQL oracle."""
