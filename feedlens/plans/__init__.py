"""Plan building blocks shared by operators, and the registered query catalog."""
