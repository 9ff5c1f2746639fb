"""Audits and the monthly report, composed from the views."""
