"""feedlens: feedback analytics as lazy Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` built from
built-in Spark expressions; nothing is collected to the driver.
"""

import sys as _sys

__version__ = "0.1.0"

# The few Python-worker functions (lane packer, scorer/generator wrappers,
# per-task top-k) live in this package. Pickling the package by value lets
# executors run them without the package being installed on every node.
try:  # pragma: no cover - depends on the bundled cloudpickle
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: ship the package with --py-files instead
    pass
