"""dwell — duration analytics on event data, written on the public Spark API.

Every operator is a ``DataFrame -> DataFrame`` function (or a function returning a
small, aggregated DataFrame).  Nothing on the data path runs row-at-a-time Python.
"""

__version__ = "0.1.0"
