"""lathe: tabular data preparation and model evaluation on Spark DataFrames.

Every operator takes and returns DataFrames. Fitting an operator runs one or a few
distributed aggregations and brings only the fitted parameters (a handful of numbers
or category lists per column) to the driver; applying it is a projection.
"""

__version__ = "0.1.0"
