"""Lumenspan: highlight analytics on timed event data, written for Spark."""
