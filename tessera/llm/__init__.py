"""Operations of a training-data pipeline on documents and embeddings.

Nothing else in the library imports this subpackage; ``catalog`` holds its queries."""
