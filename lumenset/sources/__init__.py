"""Tables, views, files and the read-only console."""
