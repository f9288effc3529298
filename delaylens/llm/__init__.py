"""Training-data operators: one module per operator, general interfaces in
each module, the registered queries in ``queries`` and their SQL in ``oracle``."""
