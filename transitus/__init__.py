"""Spark operators for care transitions, document review, denials and reimbursement."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: what tasks use of it travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
