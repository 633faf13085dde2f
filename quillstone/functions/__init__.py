"""Column functions and the expressions built from them."""
