"""Corpus-scale text-quality analytics and rewrite evaluation on PySpark."""
