"""Readers and writers: workspaces, project files, snapshots, annotations."""
