"""vigil: Spark-native jobs for AI-operations data.

Every operator is a function that takes DataFrames (plus plain parameters)
and returns a DataFrame.  Nothing is collected to the driver; the work is
expressed with the DataFrame API so Catalyst can prune, push down and pick
join strategies.
"""

__version__ = "0.1.0"
