"""From query text to lazy DataFrames, and the registered queries."""
