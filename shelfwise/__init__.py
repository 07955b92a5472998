"""shelfwise: recommendation analytics for e-commerce event data, on PySpark DataFrames."""
