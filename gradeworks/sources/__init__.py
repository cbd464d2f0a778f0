"""Readers and writers of the corpus, results and document formats."""
