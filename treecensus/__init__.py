"""treecensus: file-tree inventory analytics on Spark DataFrames.

One row per file, directory or symlink goes in; reports, comparisons and
reviewable action plans come out.  Nothing in this package touches the storage
it describes: a bulk change is always returned as a table of planned actions.
"""

__version__ = "0.1.0"
