"""Operators over rules, records and their stores."""
