"""Training-data operators: ten corpus-scale text operators and their queries.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
returns a DataFrame and is lazy except for bounded model fitting and, where a
graph has to be closed over, checkpointed iterations.
"""
