"""Operations of a training-data pipeline: quality, tokens, similarity, licenses, dedup, search, language, toxicity, packing."""
