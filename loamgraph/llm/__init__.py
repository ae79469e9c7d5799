"""Operators that prepare code and text for language models. Nothing else in the package imports this one."""
