"""Formats whose files are read whole: one module for each family, each with a table FORMATS."""
