"""grainline: grain-safe business metrics, reconciliation and log analytics on Spark DataFrames.

``plans`` holds models, joins, saved specs and broadcast guards; ``functions`` column expressions;
``operators`` DataFrame-to-DataFrame operators; ``sources`` the table bindings and file sources/sinks;
``streaming`` the Structured Streaming variants; ``catalog`` the registered questions with their oracles.
"""

__version__ = "0.1.0"
