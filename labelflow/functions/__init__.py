"""Column functions: text cleaning, label values, keywords and file names."""
