"""Temporal payment-graph analytics and corpus operators on Spark."""
