"""Configuration, composed pipelines, and the registered queries."""
