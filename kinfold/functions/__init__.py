"""Column-level helpers over vectors and paths."""
