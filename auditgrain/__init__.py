"""Claim-audit analytics on Spark."""
