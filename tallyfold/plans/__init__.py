"""Queries of the operators over the test tables, with their SQL, by section."""
