"""Composed jobs (classify, evaluate, tune) and the catalogue of registered queries."""
