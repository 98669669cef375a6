"""Column expressions and batch functions.

Modules with batch functions are pickled by value, so executors need no copy of
this package to run them.
"""

from pyspark import cloudpickle

from . import markup, ordered, text

for _module in (markup, ordered, text):
    cloudpickle.register_pickle_by_value(_module)
