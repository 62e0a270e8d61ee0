"""Training-data operators: one module per operator, all DataFrame in, DataFrame out.

Nothing outside this subpackage imports it. Common conventions:

* extra input columns never clash: working columns are built from a narrow projection, and whole
  rows travel packed in one struct column where they have to be returned;
* a null text is "no text": it is kept, never compared or counted, unless a docstring says otherwise;
* ties are broken by the smallest document id (nulls last), so results do not depend on partitioning.
"""
