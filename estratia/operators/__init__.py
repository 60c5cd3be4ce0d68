"""Relational operators: joins, aggregates, order statistics, reshaping, factors and checks."""
