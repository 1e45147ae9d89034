"""Corpus, retrieval and test-data work as PySpark DataFrame jobs.

``functions``  column expressions (no DataFrame, no shuffle)
``operators``  DataFrame -> DataFrame steps
``sources``    readers, the knowledge-base table and exports
``plans``      end-to-end jobs and the catalog of registered queries
``streaming``  incremental counterparts of the batch jobs
"""
