"""Column expressions: text cleaning, response parsing, prompt rendering, n-gram features."""
