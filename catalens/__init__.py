"""catalens: a Spark-native engine for file and media catalogues.

Every operator is a function from DataFrames to DataFrames. The subpackage ``llm`` holds the operators for
training data; nothing outside it imports it.
"""

__version__ = "0.1.0"
