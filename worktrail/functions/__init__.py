"""See the package README for the operators in this folder."""
