"""Column expressions: text, patterns, placeholders, glossary, validation."""
