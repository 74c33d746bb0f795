"""Training-data operators: ten DataFrame operators, their registered queries and SQL.

Nothing else in the package imports this subpackage.
"""
