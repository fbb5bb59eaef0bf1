"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Common rules for every operator here:

* ``doc_id`` is a long and ``text`` a string; either may be null.  A null text
  counts as empty unless the operator says otherwise.
* Only the columns an operator needs are read, under private names, so further
  input columns (also ones named like an output) never clash.
* Rows that repeat both id and text are one document seen twice: each row gets
  the same answer.
* An empty table gives an empty result of the same schema.
"""
