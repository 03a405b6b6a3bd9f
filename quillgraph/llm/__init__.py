"""Training-data operators: thirteen Spark jobs over documents, embeddings and pages.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_<name>`` queries; each operator has a module of its own with a general
interface on DataFrames.
"""
