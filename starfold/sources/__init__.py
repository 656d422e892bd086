"""Where tables and definition files are read from."""
