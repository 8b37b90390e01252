"""Column functions: names, texts and pair features."""
