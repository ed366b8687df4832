"""Whole plans: detection, redaction, evaluation, and the driver's queries."""
