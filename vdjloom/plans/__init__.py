"""Composite plans: the flagship query and the three read workflows."""
