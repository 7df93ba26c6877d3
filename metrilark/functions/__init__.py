"""Column functions: text processors, tokenizers, templates, parsers and constraint checks."""
