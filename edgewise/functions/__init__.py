"""Column functions shared by the operators."""

from edgewise.functions.cleaning import clean_name, clean_source, clean_value, present

__all__ = ["clean_name", "clean_source", "clean_value", "present"]
