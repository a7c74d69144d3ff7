"""A PySpark engine for short-tandem-repeat genomics and, in the subpackage llm, for training corpora."""
