"""labelforge: relevance-labelled training data on Spark.

Two families of DataFrame operators:

* mining (``operators.bm25``, ``operators.dense``, ``operators.ivf``,
  ``operators.fusion``, ``operators.candidates``): deduplicate a corpus,
  retrieve per query with BM25 and dense vectors, fuse with reciprocal rank
  fusion and emit deterministic hard-negative candidate pairs;
* annotation processing (``operators.planning``, ``operators.submissions``,
  ``operators.votes``, ``operators.lifecycle``, ``operators.reports``):
  set-based versions of batch claims, submission handling, vote settlement,
  batch expiry and progress reports.

Every operator takes DataFrames and returns DataFrames; nothing is collected.
"""

__version__ = "0.1.0"
