"""Table operators: ``DataFrame -> DataFrame`` functions with key and order columns as arguments."""
