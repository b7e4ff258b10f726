"""See the package README for the relations used here."""
