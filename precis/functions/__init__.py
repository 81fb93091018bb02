"""Column expressions and the Arrow UDFs.

The UDF modules are pickled by value, so Python workers need no copy of this package.
"""

from pyspark import cloudpickle

from precis.functions import bags, lcs, stemming

for _module in (bags, lcs, stemming):
    cloudpickle.register_pickle_by_value(_module)
