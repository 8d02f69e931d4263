"""From chains to lazy DataFrames and to SQL text."""
