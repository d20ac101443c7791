"""memloom: agent-memory knowledge-graph analytics as PySpark plans.

``operators`` holds the table operators, ``functions`` the Column builders,
``sources`` the readers and the versioned store, ``plans`` the query registry,
``streaming`` the Structured Streaming jobs and ``llm`` the corpus operators,
which nothing outside that subpackage imports.
"""
