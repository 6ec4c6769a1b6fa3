"""millrace: analytics operators as plain ``DataFrame -> DataFrame`` functions."""
