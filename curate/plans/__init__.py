"""Operators put together: rule-driven cleaning, the star schema and the marts."""
