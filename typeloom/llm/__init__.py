"""Training-data operators: ten numbered operators and the corpus pipeline's building blocks.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
