"""Table descriptions, statements, their validation, and their lowering to DataFrames."""
