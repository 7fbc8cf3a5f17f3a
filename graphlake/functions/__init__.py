"""Types, scalar functions and predicate expressions."""
