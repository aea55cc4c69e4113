"""Readers and writers for manifests, metric tables and slice stores."""
