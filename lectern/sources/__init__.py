"""Files and tables that the operators read."""
