"""Column expressions: paths, text, digests, canonical JSON, globs, ids."""
