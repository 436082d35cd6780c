"""Training-data operators: ten independent components over plain DataFrames.

Nothing outside this folder imports it; ``queries.py`` registers them.
"""
