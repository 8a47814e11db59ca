"""Column functions: text cleaning, codes, arrays and vectors."""
