"""Stage tables of a dataset and the catalogue of runnable queries."""
