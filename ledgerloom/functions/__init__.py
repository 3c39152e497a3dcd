"""Reusable Column builders: predicates, text parsers, classifiers, checks."""
