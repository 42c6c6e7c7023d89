"""DataFrame operators; each takes and returns DataFrames so ``df.transform`` composes them."""
