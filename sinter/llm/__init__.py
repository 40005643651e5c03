"""Training-data operators: language id, toxicity, nearest neighbours, URL
filters, token files, packing, chat formatting, mixing, near-duplicate
removal, quality rules, whitening and collocations. Nothing outside this package imports it."""
