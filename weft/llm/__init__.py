"""Operators for preparing large text corpora, each as Spark jobs over whole tables."""
