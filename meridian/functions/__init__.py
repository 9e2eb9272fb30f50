"""Column expressions: text, dates, geodesy, identifiers."""
