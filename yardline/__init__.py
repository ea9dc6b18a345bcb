"""Fleet analytics for leased equipment, written as Spark DataFrame jobs.

Inputs are a unit master table, lease history, invoice lines, a card-rate
(benchmark price) table and current GPS positions.  Everything is lazy: each
function takes DataFrames and returns a DataFrame, and "now" is always the
explicit ``as_of`` argument.
"""
