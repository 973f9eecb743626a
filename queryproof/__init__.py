"""queryproof: prove that two Spark queries return the same data, and report on rewrite runs.

Everything is a ``DataFrame -> DataFrame`` function; nothing runs until the caller asks for rows.
"""

__version__ = "0.1.0"
