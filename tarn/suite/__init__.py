"""The catalog over the generated test tables, and one registered query for each operator."""
