"""Readers for the registered tables and for loosely structured text inputs."""
