"""Outputs: lists, mappings, formatted sheets, reports."""
