"""Readers and workload builders."""
