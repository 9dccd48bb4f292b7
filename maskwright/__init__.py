"""Sensitive-data analytics on Spark: scanning, masking and proving, box and
tile analytics, policy, planning and audit, as DataFrame functions."""
