"""Recovers tables from many non-uniform spreadsheets and brings them into one layout."""
