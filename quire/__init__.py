"""Lexical, formal and comparative analysis of text corpora as Spark DataFrame operators."""
