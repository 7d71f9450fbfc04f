"""Column functions and small parsers shared by the operators."""
