"""Operations of a training-data pipeline on Spark tables of documents, pages and vectors.

Nothing outside this subpackage imports it.
"""
