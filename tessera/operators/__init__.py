"""Index, ranking, vector, fusion and filter operators."""
