"""Whole evaluations, their declarative setups and the registered queries."""
