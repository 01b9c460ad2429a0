"""Training-data operators (personal data, duplicates, tokens, mixing, classifiers, packing) and their queries."""
