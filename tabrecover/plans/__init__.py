"""Plan shapes shared by the operators: joins, row blocks, positions."""
