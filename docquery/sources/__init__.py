"""Reading files and pages into the page schema."""
