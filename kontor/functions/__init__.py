"""Column functions: text, amounts, dates, IBANs, vectors."""
