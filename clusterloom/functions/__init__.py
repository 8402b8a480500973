"""Measures of a clustering and of its agreement with another one."""
