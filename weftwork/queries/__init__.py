"""Registered queries: operator patterns over the tables, and stylesheet operators over literals."""
