"""Column expressions: amounts, rates, text, JSON access and check rows."""
