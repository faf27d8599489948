"""Readers and writers: photo folders, manifests, reports, base64 streams."""
