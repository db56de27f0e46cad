"""Training-data operators: cleaning, matching and tokenising text corpora at cluster scale.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries`` holds the thin registered queries.
"""
