"""Vessel-tracking analytics on Spark: one declarative plan from feed to answer."""
