"""functions of the engine: plain functions over DataFrames."""
