"""Column functions: text normalisation, set and string similarity, vectors."""
