"""Operations for training-data pipelines: filtering, deduplication, archives and mixing of documents."""
