"""Expression helpers shared by operators."""
