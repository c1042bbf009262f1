"""Operators for training-data pipelines. Nothing outside this folder imports them.

Rules that hold for every operator here, unless its docstring says otherwise:

* null texts count as empty; null ids are kept as rows and sort first;
* rows with equal ids are separate rows, and each gets its own result;
* extra columns, whatever their names, are ignored or passed through untouched;
* an empty table gives an empty result with the same columns.
"""
