"""Column expressions: text, numbers, status codes, grading, document cleaning, prompts."""
