"""The four stages. Each has a lazy part (DataFrames in, DataFrames out) and a
``run_…`` function that reads paths and writes outputs."""
