"""docshield: guarded document retrieval written as Spark DataFrame jobs.

Layout
------
- ``functions``  Column builders (no shuffles): guard predicates, redaction regexes,
  vector math, question parsing, display rules.
- ``operators``  DataFrame -> DataFrame operators: chunking, embedding, top-k search,
  tokenisation maps, history, guard checks, audit, library.
- ``sources``    table loading, document scans, index and policy stores.
- ``plans``      composed flows (ingest, guarded turn, suggestions) and the query registry.
- ``streaming``  Structured Streaming forms of ingest, guard and audit roll-up.
"""

__version__ = "0.1.0"
