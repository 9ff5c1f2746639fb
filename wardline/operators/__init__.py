"""Governed reads, policy checks, tag rules, privileges and monitoring views."""
