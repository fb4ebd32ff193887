"""Operators for large text corpora.  Nothing else in the package imports this one."""
