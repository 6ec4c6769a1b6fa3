"""Column expressions: text cleaning, hashing, array arithmetic."""
