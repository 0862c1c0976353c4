"""Part of loomspark; see README.md."""
