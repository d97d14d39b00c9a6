"""Table-to-role mappings and the registered queries built on the operators."""
