"""Training-data operators: token counts, mixing, nearest neighbours, token files, language ID,
exact and near deduplication, web captures, packing and chat formatting."""
