"""Column builders: actions, normalizers, similarity, merge strategies."""
