"""Column functions: text, numbers, dates, labels and vectors."""
