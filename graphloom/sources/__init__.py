"""Tables, their adapters, stores and file sources."""
