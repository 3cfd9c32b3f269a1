"""churnkit: customer-attrition analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
``fit`` returning parameter tables) parameterised by column names.
"""

__version__ = "0.1.0"
