"""Relational operators, grouped by the job they do."""
