"""Data preparation operators: a fit step (small result) and an apply step."""
