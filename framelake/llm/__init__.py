"""Operators for building training corpora from documents, pages, embeddings and labels."""
