"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the package imports this one. Shared conventions:

* Each operator first selects the columns it names, so extra columns, whatever they are
  called, never clash with its own.
* A null text counts as an empty one. Rows with a null id are kept and treated as rows.
* Repeated ids are separate rows; where an order of documents matters, equal ids are
  ordered by their text.
* Intermediate tables go to the folder in ``spark.checkpoint.dir``.
"""
