"""Column functions: fixed values, timestamps, addresses; cutting lineage."""
