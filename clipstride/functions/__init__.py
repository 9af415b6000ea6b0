"""Column builders. Nothing here reads data or holds a session."""
