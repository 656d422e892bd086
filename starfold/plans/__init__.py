"""The semantic model and its queries."""
