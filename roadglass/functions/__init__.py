"""Column functions: text, numbers, dates, scores."""
