"""Column functions: text, dates, tags, names, identity, accounting."""
