"""Brute-force versions that several tests use."""

from test_jaccard import survivors  # noqa: F401
from test_line_templates import brute as kept_lines  # noqa: F401
