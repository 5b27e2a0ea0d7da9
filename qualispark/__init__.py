"""Evaluation of machine translation and curation of training text, as Spark DataFrame operators."""
