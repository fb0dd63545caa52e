"""Column functions: text, hashing, JSON and prompt templates."""
