"""Column functions: text, addresses, dates, ids, scores."""
