"""DataFrame operators: preparation, merging, embedding, retrieval, ranking."""
