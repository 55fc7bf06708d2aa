"""Column functions: registry text and survey geometry."""
