"""Column functions and driver-side rules shared by the operators."""
