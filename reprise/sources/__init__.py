"""Reading files, their tags and their sound; writing tags."""
