"""Operators for building language-model training data.

Ten operators, one module each; ``queries`` registers them and ``entry`` points in
``__spark_entry__.py`` pick them up.  Nothing outside this subpackage imports it.

Conventions shared by every operator:

* the text and id columns are parameters; other input columns pass through untouched, and an
  input column whose name (ignoring case) equals an output column is replaced by it;
* a null text counts as an empty text unless the operator says otherwise;
* rows are never dropped, capped or cut short: whole texts are processed, and repeated rows give
  repeated results;
* an empty table gives an empty result with the same columns.
"""
