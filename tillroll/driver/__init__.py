"""Retail tables derived from the star-schema test tables, with the queries over them."""
