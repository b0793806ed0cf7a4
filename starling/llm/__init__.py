"""Operators for preparing training data: counting and storing tokens, search,
duplicate removal, decontamination, packing, personal data and toxicity.

Nothing else in the library imports this package. Rules shared by all operators:

* Only the id, text (or vector) columns named in the call are read, so extra
  columns, whatever their names, change nothing. Operators that return whole
  rows keep every column of their input.
* A null text counts as an empty one. A null id stays null in the result.
* Rows that repeat both id and text are one document: they get the same answer.
* Empty tables give empty results with the same columns.
"""
