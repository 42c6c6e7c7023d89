"""fleetscope: observability and operations analytics as Spark DataFrame operators.

Subpackages: ``functions`` (scalar columns), ``sources`` (readers and writers),
``operators`` (DataFrame -> DataFrame operators), ``plans`` (order-aware window
helpers, fixture views, registered queries), ``streaming`` (stream forms).
"""

__version__ = "0.1.0"
