"""Column functions: no function here plans a shuffle."""
