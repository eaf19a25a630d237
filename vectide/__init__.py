"""vectide: vector analytics and corpus checks as plain PySpark DataFrame programs.

Layout
------
``functions``  vector parsing, arithmetic and distances (native columns, Arrow kernels, SQL names)
``operators``  kNN, joins, graph statistics, the sharded proximity graph, reference checks
``sources``    versioned vector tables, page dumps, result sinks
``plans``      access-path choice and ``explain``
``streaming``  incremental insert from a stream
``llm``        operators for training text; optional, nothing outside it imports it
"""

__version__ = "0.1.0"
