"""fieldloom: object-level trait analytics as Spark plans.

Subpackages: ``sources`` (readers, writers, table fixtures), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (named
queries with their SQL counterparts), ``streaming`` (incremental file input).
``llm`` holds corpus operators and stands alone: nothing else imports it.
"""
