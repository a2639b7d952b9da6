"""Noisy-text corpora, clean/noisy pairing and robustness evaluation on Spark DataFrames."""
