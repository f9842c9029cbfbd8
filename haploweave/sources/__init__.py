"""Readers and writers: Nexus text, project documents, edge lists, drawings."""
