"""Column functions on paths, references and text."""
