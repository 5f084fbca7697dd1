"""Queries over streams: the part of the query language that needs no order and no page."""
