"""Spark-native retrieval and curation of long documents.

The package is split the way a Spark job is: ``sources`` read and write data
sets, ``functions`` build columns, ``operators`` turn DataFrames into
DataFrames, ``streaming`` holds the stateful twins and ``plans`` wires the
operators to the tables of the driver contract.
"""

from paperloom.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
