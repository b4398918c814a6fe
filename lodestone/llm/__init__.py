"""Operators that prepare training data: dedup, packing, mixing, sharding, search.

Nothing outside this folder imports it.  Every operator takes DataFrames, reads
only the columns that it names, and returns a DataFrame; what has to be cut off
from its lineage is written below ``spark.checkpoint.dir`` (see ``workspace``).
"""
