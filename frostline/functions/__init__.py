"""SQL fragments shared by the operators."""
