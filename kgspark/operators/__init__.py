"""Set-based operators: each takes and returns DataFrames keyed by ``user_id``."""
