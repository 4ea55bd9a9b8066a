"""socialspark: analytics for large collections of social-media posts on PySpark.

Sub-packages: ``functions`` (Column expressions), ``operators`` (DataFrame to
DataFrame building blocks), ``sources`` (readers and writers), ``plans``
(pipelines made of operators) and ``streaming``.
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the task, so that
# executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
