"""tessera: a Spark-native engine for table question-answering data work.

Tables become one keyed cell table, are rendered to bounded text, solved
examples are retrieved by several similarity strategies, prompts are
assembled, replies parsed and prediction runs scored, all as Spark jobs.
"""

__version__ = "0.1.0"
