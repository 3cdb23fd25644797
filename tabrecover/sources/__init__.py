"""Inputs: workbook files, tables, line lists and stored mappings."""
