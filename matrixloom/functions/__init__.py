"""Column functions and relational helpers shared by all operators."""
