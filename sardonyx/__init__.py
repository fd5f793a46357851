"""sardonyx — a labelled-text preparation, scoring and evaluation library on PySpark.

Every public function takes DataFrames and returns DataFrames; the work is
declared with the DataFrame API so Catalyst and AQE plan it.  Sub-packages:

* ``functions`` — column expressions (no Python UDFs)
* ``operators`` — DataFrame -> DataFrame building blocks
* ``sources``   — readers / writers and the bindings of the test tables
* ``plans``     — end-to-end jobs (corpus, training, evaluation, query catalog)
* ``streaming`` — Structured Streaming scoring
"""

__version__ = "0.1.0"
