"""Joins, groupings and orderings that searches and indexing are made of."""
