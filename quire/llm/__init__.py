"""Training-data operators.

Each module holds one operator with a general interface; ``queries`` binds them
to the driver's tables. Nothing else in the library imports this package.
"""
