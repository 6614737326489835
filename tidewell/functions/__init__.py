"""Column functions: hashes, rates, filters, JSON and templates."""
